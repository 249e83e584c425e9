"""Operator 5: token counts by section, attributed through offsets.

A document is encoded once, whole. The bytes of its tokens give each token's
span; an interval join of these spans with the spans of the sections attributes
every token to one section. A token that crosses boundaries goes to the section
that holds most of its bytes, the earlier of equals.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: white space as the pattern's engine knows it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The engine tracks back over a run of blanks and breaks down on very long ones; such runs are cut out first.
LONG_BLANKS = re.compile(rf"[{BLANK}]{{1000,}}")


@dataclass
class Encoder:
    """A byte-level vocabulary, small and of fixed size, that travels with the task."""

    file: bytes

    @classmethod
    def read(cls, path: str) -> Encoder:
        with open(path, "rb") as f:  # on the driver alone
            return cls(f.read())

    def __getstate__(self) -> dict:
        return {"file": self.file}

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.file.splitlines() if line)}

    @cached_property
    def encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def lengths(self) -> np.ndarray:
        out = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, i in self.ranks.items():
            out[i] = len(token)
        return out

    def tokens(self, text: str) -> list[int]:
        """Tokens of the whole text, with long runs of blanks encoded as the pieces the pattern makes of them.

        The pattern ends a piece where a run begins. All of a run but its last
        blank is one piece, and that blank goes with what follows; at the end of
        the text the whole run is one piece.
        """
        out: list[int] = []
        at = 0
        for run in LONG_BLANKS.finditer(text):
            out += self.encoding.encode_ordinary(text[at : run.start()])
            at = run.end() - (run.end() < len(text))
            out += self.encoding._encode_single_piece(text[run.start() : at].encode())
        return out + self.encoding.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """Byte offset after each token of the text."""
        return np.cumsum(self.lengths[np.array(self.tokens(text), np.int64)])


def line_sections(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which sections end: after each line break, and at the end of the text."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary."""
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    for t in crossing.tolist():
        bounds = np.clip(section_ends[first[t] : last[t] + 1], starts[t], token_ends[t])
        owner[t] = first[t] + int(np.argmax(np.diff(bounds, prepend=starts[t])))
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(text: str | None, encoder: Encoder, sections: Callable[[np.ndarray], np.ndarray] = line_sections) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """First character, end, tokens and crossing tokens of each section; None for an empty text."""
    if not text:
        return None
    text = text.encode("utf-8", "replace").decode()  # a lone surrogate becomes a question mark
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = sections(raw)
    chars = ends if len(text) == len(raw) else np.cumsum((raw & 0xC0) != 0x80)[ends - 1]
    tokens, crossing = attribute(encoder.ends(text), ends)
    return np.concatenate(([0], chars[:-1])), chars, tokens, crossing


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section (from 0), char_start, char_end, tokens, crossing for every line of every row of ``docs`` (doc_id, text).

    Sections are lines with the line break that ends them, so that they cover a
    text and the tokens of its sections add up to those of the whole text.

    Defined cases: null and empty texts have one section of no characters and no
    tokens; an empty line is a section of its line break; a very long text is
    encoded whole, long runs of white space too; a token that lies in two
    sections to equal parts goes to the earlier; null ids and repeated rows stay;
    an empty table gives an empty result; other columns are left out.
    """
    encoder = Encoder.read(vocabulary)
    names = ["doc_id", "section", "char_start", "char_end", "tokens", "crossing"]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 1000):
                ids, rows = [], []
                for doc_id, text in zip(*batch.slice(at, 1000).columns, strict=True):
                    got = section_tokens(text.as_py(), encoder) or (np.zeros(1, np.int64),) * 4
                    ids += [doc_id.as_py()] * len(got[0])
                    rows.append(np.stack([np.arange(len(got[0])), *got]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, np.ascontiguousarray(np.concatenate(rows, axis=1)).astype(np.int64))], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(batches, ", ".join(f"{n} long" for n in names))
