"""Operator 7: licence scans by sentence rules.

Spans of a text from a beginning of a sentence or line to an end of one are
normalised to words, and those that are known licence sentences mapped to
identifiers. The sequence of identifiers of a text is then matched against
rules: ordered lists of identifiers that stand for a licence, the longest first,
no identifier used twice.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of customary notices, by identifier.
SENTENCES = {
    "rights-reserved": ["All rights reserved."],
    "gpl3-work": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl2-work": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "ccbync4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "ccby4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "ccbysa4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "cc0-notice": ["Licensed under CC0 1.0.", "Released under CC0 1.0."],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License."],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "apache2-header": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "apache2-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice-kept": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-only-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "agpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl1-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."],
    "bsl1-distributed": ["Distributed under the Boost Software License, Version 1.0."],
    "bsl1-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "cc0-dedicated": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
}
#: Rules, each a licence and the identifiers that stand for it in order.
RULES = {
    "mit-text": ("MIT", ("mit-grant", "mit-notice-kept", "mit-warranty", "mit-liability")),
    "mit-notice": ("MIT", ("mit-notice",)),
    "bsd-3-text": ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    "bsd-2-text": ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    "isc-text": ("ISC", ("isc-grant",)),
    "apache-2-header": ("Apache-2.0", ("apache2-header", "apache2-copy", "apache2-basis", "apache2-see")),
    "apache-2-notice": ("Apache-2.0", ("apache2-notice",)),
    "gpl-3-header": ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    "gpl-3-notice": ("GPL-3.0-only", ("gpl3-work",)),
    "gpl-2-notice": ("GPL-2.0-only", ("gpl2-work",)),
    "cc-by-nc-4-notice": ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    "cc-by-4-notice": ("CC-BY-4.0", ("ccby4-notice",)),
    "cc-by-sa-4-notice": ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    "cc0-notice": ("CC0-1.0", ("cc0-notice",)),
    "rights-reserved": ("LicenseRef-all-rights-reserved", ("rights-reserved",)),
    "gpl-2-header": ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    "gpl-2-short": ("GPL-2.0-or-later", ("gpl2-free",)),
    "gpl-2-only-header": ("GPL-2.0-only", ("gpl2-only-free", "gpl-hope")),
    "gpl-2-only-short": ("GPL-2.0-only", ("gpl2-only-free",)),
    "lgpl-2.1-header": ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    "lgpl-2.1-short": ("LGPL-2.1-or-later", ("lgpl21-free",)),
    "lgpl-3-header": ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope")),
    "lgpl-3-library": ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    "lgpl-3-short": ("LGPL-3.0-or-later", ("lgpl3-free",)),
    "agpl-3-header": ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    "agpl-3-short": ("AGPL-3.0-or-later", ("agpl3-free",)),
    "mpl-2-header": ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    "mpl-2-short": ("MPL-2.0", ("mpl2-subject",)),
    "epl-1-header": ("EPL-1.0", ("epl1-terms",)),
    "epl-2-header": ("EPL-2.0", ("epl2-terms",)),
    "bsl-1-header": ("BSL-1.0", ("bsl1-distributed",)),
    "bsl-1-text": ("BSL-1.0", ("bsl1-grant",)),
    "zlib-text": ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    "unlicense-text": ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    "unlicense-short": ("Unlicense", ("unlicense-free",)),
    "0bsd-text": ("0BSD", ("0bsd-grant", "mit-warranty")),
    "cc0-dedication": ("CC0-1.0", ("cc0-dedicated",)),
}
#: Licences named in notices, by the names that notices give them.
NAMED = {
    "MIT": ("the MIT License", "MIT License", "the MIT licence", "MIT"),
    "ISC": ("the ISC License", "ISC License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache 2.0", "the Apache 2.0 License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "GPLv2", "the GPLv2"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "GPLv3", "the GPLv3"),
    "GPL-2.0-or-later": ("the GNU General Public License, version 2 or later", "the GNU General Public License, version 2 or any later version"),
    "GPL-3.0-or-later": ("the GNU General Public License, version 3 or later", "the GNU General Public License, version 3 or any later version"),
    "LGPL-2.1-only": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "Unlicense": ("the Unlicense",),
    "Zlib": ("the zlib License",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the Creative Commons CC0 License"),
}
#: What notices begin with, and the parts of Creative Commons licences.
OPENERS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "The code is licensed under")
COMMONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
COMMONS_KINDS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
COMMONS_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
WORDS = re.compile(r"[^\W_]+")
#: A sentence ends at a full stop, question or exclamation mark before white space, and with its line or text.
STOP = re.compile(r"[.!?](?=\s|\Z)|\n")
#: Characters that may lie between two sentences of a rule.
GAP = 2000


def normalise(sentence: str) -> str:
    """Its words in lower case."""
    return " ".join(WORDS.findall(sentence)).lower()


def notices() -> Iterator[tuple[str, str]]:
    """Licence and sentence of the notices that a rule makes: openers with names, Creative Commons kinds, SPDX tags."""
    names = {licence: list(several) for licence, several in NAMED.items()}
    for kind in COMMONS_KINDS:
        words = "-".join(COMMONS[part] for part in kind.split("-"))
        for version, port in COMMONS_VERSIONS.items():
            title = f"Creative Commons {words} {version}"
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", *(f"{the} {title}{more} License" for the in ("a", "the") for more in ("", f" {port}"))]
    for licence, several in names.items():
        yield licence, f"SPDX-License-Identifier: {licence}"
        for opener in OPENERS:
            for name in several:
                yield licence, f"{opener} {name}."


def known_sentences() -> tuple[dict[str, str], dict[str, tuple[str, tuple[str, ...]]]]:
    """Identifier by normalised sentence, and all rules: the written ones, and one for each licence with notices."""
    known = {normalise(x): i for i, several in SENTENCES.items() for x in several}
    rules = dict(RULES)
    for licence, sentence in notices():
        ident = f"{licence.lower()}-named"
        if known.setdefault(normalise(sentence), ident) == ident:
            rules[ident] = (licence, (ident,))
    return known, rules


def rule_table(rules: dict[str, tuple[str, tuple[str, ...]]]) -> dict[str, list[tuple[tuple[str, ...], str, str]]]:
    """Rules by their first identifier, longest first."""
    out = defaultdict(list)
    for rule, (licence, ids) in sorted(rules.items(), key=lambda r: (-len(r[1][1]), r[0])):
        out[ids[0]].append((ids, rule, licence))
    return out


def word_tree(known: dict[str, str]) -> dict:
    """Known sentences as a tree of words; the key None holds the identifier of the sentence that ends there."""
    tree: dict = {}
    for sentence, ident in known.items():
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[None] = ident
    return tree


KNOWN, ALL_RULES = known_sentences()
TREE, BY_FIRST = word_tree(KNOWN), rule_table(ALL_RULES)
#: A whole word that opens a known sentence.
OPENING = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(map(re.escape, TREE), key=len, reverse=True))})(?![^\W_])", re.I)


def begins(text: str, at: int) -> bool:
    """Whether a sentence or line may begin with the word at ``at``, after marks of a list or comment."""
    while True:
        i = at
        while i and not text[i - 1].isalnum():
            i -= 1
        if not i or STOP.search(text, i, at):
            return True
        number = re.compile(r"\d{1,2}\Z").search(text, max(0, i - 3), i)
        if text[i] != ")" or not number or (number.start() and text[number.start() - 1].isalnum()):
            return False
        at = number.start()  # a list's number: what counts is what stands before it


def sentence_at(text: str, at: int) -> tuple[int, str] | None:
    """End and identifier of the longest known sentence that begins at a word and ends where a sentence or line does."""
    node, found = TREE, None
    word = WORDS.match(text, at)
    while word and (node := node.get(word[0].lower())):
        end, word = word.end(), WORDS.search(text, word.end())
        if None in node:
            behind = word.start() if word else len(text)
            stop = STOP.search(text, end, behind)
            if stop or not word:
                found = (stop.end() if stop and stop[0] != "\n" else end), node[None]
    return found


def sentence_ids(text: str) -> list[tuple[int, int, str]]:
    """Start, end and identifier of the known sentences of a text in order; of overlapping ones the first, the longer."""
    out: list[tuple[int, int, str]] = []
    at = 0
    while m := OPENING.search(text, at):
        at = m.end()
        if begins(text, m.start()) and (hit := sentence_at(text, m.start())):
            out.append((m.start(), *hit))
            at = hit[0]
    return out


def matches(text: str | None) -> list[tuple[str, str, int, int, int]]:
    """Licence, rule, first character, end and number of sentences of every match, in order."""
    found = sentence_ids(text or "")
    out, at = [], 0
    while at < len(found):
        for ids, rule, licence in BY_FIRST.get(found[at][2], ()):
            part = found[at : at + len(ids)]
            if tuple(x[2] for x in part) == ids and all(b[0] - a[1] <= GAP for a, b in zip(part, part[1:], strict=False)):
                out.append((licence, rule, part[0][0], part[-1][1], len(ids)))
                at += len(ids)
                break
        else:
            at += 1
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, rule, char_start, char_end, sentences for every licence found in ``docs`` (doc_id, text).

    Sentences of a rule follow each other among the known sentences, at most
    ``GAP`` characters apart; what stands between them isn't looked at.

    Defined cases: null, empty and licence-free texts give no rows; a very long
    text is read whole, in linear time; of rules that fit at one place the
    longest counts, of equally long ones the first by name; null ids and repeated
    rows are each reported; a licence that occurs several times in a text is
    reported each time; an empty table gives an empty result; other columns are
    left out.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got = [(d.as_py(), *m) for d, t in zip(*batch.columns, strict=True) for m in matches(t.as_py())]
            columns = zip(*got, strict=True) if got else ([],) * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "license", "rule", "char_start", "char_end", "sentences"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, license string, rule string, char_start long, char_end long, sentences long")
