"""Golden rows of the text keys, and properties of the scorers."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.functions import similarity as sim
from kinfold.functions import text
from kinfold.operators import records

ROWS = {
    "messrs": ("M/s. Shree Balaji Traders Private Limited", "Shop No 5, near Town Hall, Pune 411 001", "india"),
    "native": ("श्री बालाजी ट्रेडर्स", "पुणे ४११००१", "IND"),
    "domain": ("www.xf-soft.co.in", "", "IN"),
    "french": ("Boulangerie d'Été Sàrl", "12 rue de l'Église 75001 Paris", "Fra"),
    "forms": ("Acme Corporation, Inc.", "1600 Elm Street, Springfield 62704-1234", "U.S.A."),
    "junk": ("N/A", "---", "India "),
    "entity": ("The Tom &amp; Jerry & Co LLC", "9 Main Road", "United States"),
    "initials": ("J. K. Smith & Sons Ltd", "221b Baker Street", "Freedonia"),
    "phone": ("Nager Coil Services - 3306988370", "Door 8229382409 36 Lake Rd", "IN"),
    "alias": ("Zephra doing business as River Health LLC", "185389 4235 Road", "US"),
    "slash": ("Alpha One F / K / A Beta Two Inc", "xx" + " yy" * 30, "US"),
    "bare": ("Sri A.K.A. Traders", "unknown", "IN"),
    "repeat": ("Trust Holdings Holdings Pvt Ltd", "1 A St", "IN"),
    "leet": ("First 5pecialists and Mitche1l 3M 24x7 B2B", "1 A St", "US"),
    "url": ("Woolen Mills LLC | www.woolen-mills.com", "1 A St", "US"),
    "null": (None, None, None),
}


@pytest.fixture(scope="module")
def ready(spark):
    raw = spark.createDataFrame([(k, *v) for k, v in ROWS.items()], "entity_id string, business_name string, business_address string, country string")
    return {r.entity_id: r for r in records.assert_latin(records.prepare(raw)).collect()}


@pytest.mark.parametrize(
    ("row", "column", "value"),
    [
        ("messrs", "name_core", "sri balaji traders"), ("messrs", "legal_suffix", "pvt ltd"), ("messrs", "name_skeleton", "sr plj trtrs"), ("messrs", "postal_code", "411001"), ("messrs", "street_number", "5"), ("messrs", "has_landmark", True), ("messrs", "country_norm", "INDIA"),
        ("native", "name_script", "devanagari"), ("native", "name_was_romanized", True), ("native", "name_skeleton", "sr plj trtrs"), ("native", "postal_code", "411001"),
        ("domain", "is_domain_name", True), ("domain", "name_core", "xf soft"), ("domain", "addr_missing", True),
        ("french", "name_core", "boulangerie dete"), ("french", "legal_suffix", "sarl"), ("french", "postal_code", "75001"), ("french", "street_number", "12"), ("french", "country_norm", "FRANCE"),
        ("forms", "name_core", "acme"), ("forms", "legal_suffix", "corp inc"), ("forms", "postal_code", "62704"), ("forms", "street_number", "1600"), ("forms", "country_norm", "US"), ("forms", "addr_has_embedded_phone", False),
        ("junk", "name_norm", ""), ("junk", "name_missing", True), ("junk", "addr_missing", True), ("junk", "country_norm", "INDIA"), ("junk", "name_script", "empty"),
        ("entity", "name_core", "tom & jerry"), ("entity", "legal_suffix", "co llc"),
        ("initials", "name_core", "jk smith & sons"), ("initials", "country_norm", "FREEDONIA"), ("initials", "street_number", "221b"),
        ("phone", "name_has_embedded_phone", True), ("phone", "name_core", "nager coil services"), ("phone", "addr_has_embedded_phone", True),
        ("alias", "name_aka", "river health"), ("alias", "name_core", "zephra river health"), ("alias", "street_number", "185389"), ("alias", "addr_has_embedded_phone", False),
        ("slash", "name_aka", "beta two"), ("slash", "addr_is_multi_location", True), ("bare", "name_aka", ""), ("bare", "name_core", "sri aka traders"),
        ("repeat", "name_core", "trust holdings"), ("leet", "name_latin", "first specialists & mitchell 3m 24x7 b2b"), ("url", "name_core", "woolen mills"), ("url", "legal_suffix", "llc"),
        ("null", "name_norm", ""), ("null", "country_norm", "UNKNOWN"), ("null", "name_n_tokens", 0),
    ],
)
def test_golden(ready, row, column, value):
    assert ready[row][column] == value


def test_no_nulls_and_checks(spark, ready):
    assert all(v is not None for r in ready.values() for v in r)
    raw = spark.createDataFrame([("S1-1", "A", "b", "US"), ("S1-1", "A", "b", "US")], "entity_id string, business_name string, business_address string, country string")
    got = {r.check: r.passed for r in records.checks(records.prepare(raw), raw, "S1-").collect()}
    assert got == {"rows kept": True, "ids unique": False, "id prefix": True, "no nulls": True, "latin keys": True}


def test_phrases_are_one_pass(spark):
    got = spark.createDataFrame([("private limited liability company",)], "s string").select(text.canonical_name(text.F.col("s"))).first()[0]
    assert got == "pvt ltd liability co"


def test_scripts_and_native_vocabulary(spark):
    df = spark.createDataFrame([("தமிழ் abc", 0), ("абв где", 1), ("12 34", 2), ("!!", 3), ("ab தமி", 4)], "s string, i int")
    got = df.select(text.name_script(text.F.col("s")).alias("a"), text.is_mixed_script(text.F.col("s")).alias("m"), text.native_vocabulary(text.F.col("s"), {"தமி": "tami"}).alias("n")).collect()
    assert [r.a for r in got][1:4] == ["cyrillic", "numeric", "other"] and [r.m for r in got] == [True, False, False, False, True] and got[4].n == "ab tami"
    pair = spark.createDataFrame([("latin", "tamil"), ("latin", "numeric")], "a string, b string")
    assert [r[0] for r in pair.select(text.is_cross_script(text.F.col("a"), text.F.col("b"))).collect()] == [True, False]


ADDRESSES = [
    ("12 bis r de la paix 75002 paris", "FRANCE", "", ("75002", "12", ["paix", "rue"], True)),
    ("paris 75011 12 r oberkampf", "FRANCE", "", ("75011", "12", ["oberkampf", "rue"], True)),
    ("plot 7 lake view", "INDIA", "411 001", ("411001", "7", ["lake", "plot", "view"], False)),
    ("", "US", "", ("", "", [], False)),
    ("3 rue des lilas ile de france val d oise", "france", "", ("", "3", ["lilas", "rue"], True)),
    ("62704 1600 elm st ste 5", "US", "", ("62704", "1600", ["elm", "street"], True)),
    ("mg road 560001 bangalore shop 9", "INDIA", "", ("560001", "9", ["road"], True)),
    ("av a b c d e f g h", "FRANCE", None, ("", "", ["a", "avenue", "b", "c", "d", "e"], True)),
    (None, None, None, ("", "", [], False)),
]


def test_address_parser(spark):
    rows = [(i, *x[:3]) for i, x in enumerate(ADDRESSES)]
    df = spark.createDataFrame(rows, "i int, a string, c string, h string")
    got = {r.i: r.k for r in text.with_address(df, text.F.col("a"), text.F.col("c"), text.F.col("h"), "k").collect()}
    for i, (_, _, _, want) in enumerate(ADDRESSES):
        assert (got[i].postal, got[i].house, got[i].street_strong) == (want[0], want[1], want[3]), i
    assert [got[i].street for i in (0, 1, 2, 3, 4, 5, 8)] == [plain_street(*ADDRESSES[i][:2]) for i in (0, 1, 2, 3, 4, 5, 8)]


def plain_street(addr, country):
    """Street words by hand: from the first word for a street to the first number or word for a unit, five besides; else all words."""
    v = text.vocab
    country = (country or "").upper()
    words = addr or ""
    for region in sorted(v.FR_REGIONS, key=len, reverse=True) if country == "FRANCE" else ():
        words = re.sub(rf"\b{region}\b", " ", words)
    short, types = (v.ABBR_FR, v.STREET_TYPES_FR) if country == "FRANCE" else (v.ABBR_EN, v.STREET_TYPES_EN)
    words = [short.get(w, w) for w in words.split()]
    breaks = lambda w: w[0].isdigit() or w in v.UNIT_WORDS
    if not any(w in types for w in words):
        return sorted({w for w in words if not breaks(w) and w not in v.STOP_WORDS})
    at = next(i for i, w in enumerate(words) if w in types)
    tail = words[at + 1 :]
    tail = tail[: next((i for i, w in enumerate(tail) if breaks(w)), len(tail))]
    return sorted({words[at], *[w for w in tail if w not in v.STOP_WORDS][:5]})


def test_every_script_becomes_ascii(spark):
    names = ["Пётр Щука", "Ελληνική Τράπεζα", "שלום בע", "شركة النور", "カフェ さくら", "서울 식당", "北京 银行", "ไทย ธนาคาร", "ქართული", "Հայ", "Łódź Straße Æther", "ॐ श्री", "№ ① ½", "🙂 x"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(text.romanise(text.F.col("s"))).collect()]
    assert all(g.isascii() for g in got)
    assert [got[i] for i in (0, 4, 5, 10)] == ["pyotr shchuka", "kahue sakura", "seoul sigdang", "lodz strasse aether"]
    assert got[1].startswith("ellinik") and got[3] and got[6].startswith("x5317x4eac")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


WORDS = st.text(alphabet="abc ", max_size=12)


@given(WORDS, WORDS)
@settings(max_examples=150)
def test_scorers(a, b):
    assert sim.lcs_length(a, b) == lcs(a, b)
    for f in (sim.ratio, sim.token_sort, sim.token_set, sim.jaro_winkler, sim.partial):
        assert 0 <= f(a, b) <= 1
        if f is not sim.jaro_winkler:  # whose matches depend on which side is walked
            assert abs(f(a, b) - f(b, a)) < 1e-9
    assert sim.ratio(a, a) == 1


def test_known_scores():
    assert sim.ratio("kitten", "sitting") == pytest.approx(8 / 13)
    assert sim.token_sort("b a", "a b") == 1 and sim.token_set("a b", "a b c") == 1 and sim.token_set("a b", "c d") < 1
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and sim.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert sim.partial("abc", "xxabcxx") == 1
