import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samewise.functions import similarity as sim
from samewise.functions import text

words = st.text(alphabet="abcdé ", max_size=14)


@given(words, words)
@settings(max_examples=150, deadline=None)
def test_kernels_hold_their_bounds(a, b):
    lcs, sub = sim.longest_subsequence(a, b), sim.longest_substring(a, b)
    assert lcs == sim.longest_subsequence(b, a) and sub == sim.longest_substring(b, a)
    assert 0 <= sub <= lcs <= min(len(a), len(b))
    plain = max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)
    assert sub == plain
    assert 0 <= sim.jaro_winkler(a, b) <= 1
    n, total = sim.common_blocks(a, b, 2)
    assert total >= 2 * n and total <= min(len(a), len(b))


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_subsequence_of_long_texts():
    rnd = random.Random(3)
    for _ in range(50):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 200))) for _ in range(2))
        assert sim.longest_subsequence(a, b) == plain_subsequence(a, b)


def test_jaro_winkler_known_values():
    assert sim.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-5)
    assert sim.jaro_winkler("abcd", "abxxxxxxx") == pytest.approx(0.574, abs=1e-3)
    assert sim.jaro_winkler("", "a") == 0 and sim.jaro_winkler("a", "a") == 1


def test_fuzzy_ratios():
    assert sim.partial_ratio("plate", "a plate of") == 100
    assert sim.weighted_ratio("red plate", "plate red") >= 95
    assert sim.weighted_ratio("", "x") == 0


CASES = [
    ("clean", text.normal, "Café-Bar (Nord)", "cafebar nord"),
    ("closed", lambda c: text.normal(c, spaces=False), "Ca fé", "cafe"),
    ("stop", text.without_stop_words, "the house of cards inc", "house cards"),
    ("ordinals", text.without_ordinals, "5th and 2 nd", "5 and 2"),
    ("address", text.address, "main street 5 road", "main str 5 rd"),
    ("phone", text.phone, "+1 (555) 012-3456", "550123456"),
    ("no_phone", text.phone, "none", ""),
    ("url", text.url, "https://www.a-b.com", "abcom"),
    ("brackets", text.without_abbreviation, "a long name here (ABC) x", "a long name here  x"),
    ("kept", text.without_abbreviation, "a long name here (abc) x", "a long name here (abc) x"),
    ("initials", text.initials, "the Big Red barn", "brb"),
    ("seven", text.seven_eleven, "my 7-11 shop", "my seven eleven shop"),
    ("mac", text.mac_donald, "mcd house", "mac donaldhouse"),
    ("trans", lambda c: text.ordered_translation(c, {"utara": "north", "danau": "lake"}, ("north",), ("lake",)), "danau utara", "north lake"),
]


def test_text_functions(spark):
    row = spark.range(1).select(*[f(F.lit(given_)).alias(n) for n, f, given_, _ in CASES]).first()
    assert {n: row[n] for n, *_ in CASES} == {n: want for n, _, _, want in CASES}


def test_language_and_numbers(spark):
    df = spark.createDataFrame([("plain",), ("niño",), ("привет",), ("",)], "t string")
    assert [r[0] for r in df.select(text.language_class(F.col("t"))).collect()] == [1, 2, 3, 1]
    df = spark.createDataFrame([("a 12 b 7", "7 12"), ("1 2", "2 3"), ("x", "1"), ("x", "y"), ("1", "2"), ("1 2", "1")], "a string, b string")
    got = [r[0] for r in df.select(sim.number_agreement(text.number_tokens(F.col("a")), text.number_tokens(F.col("b")))).collect()]
    assert got == [3, 1, -1, 0, -2, 2]


def test_native_substring_matches_kernel(spark):
    rnd = random.Random(1)
    rows = [tuple("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(2)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(sim.common_substring(F.col("a"), F.col("b"))).collect()]
    assert got == [sim.longest_substring(a, b) for a, b in rows]


def test_letters_of_other_alphabets(spark):
    pairs = [("Straße Łódź", "Strasse Lodz"), ("Ångström Œuvre æ", "Angstrom OEuvre ae"), ("Москва Щука", "Moskva Shchuka"), ("Αθήνα φως", "Athena phos"), ("e\u0301a", "ea"), ("東京", "東京"), ("", ""), (None, None)]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string")
    assert [r[0] for r in rows.orderBy("i").select(text.plain(F.col("x"))).collect()] == [b for _, b in pairs]


def test_mapped_in_passes(spark):
    rows = spark.createDataFrame([(x,) for x in ("a", "b", "c", "z", None)], "x string")
    passes = ({"a": "b", "b": "c"}, {"c": "a"})
    assert [r[0] for r in rows.select(text.mapped(F.col("x"), *passes)).collect()] == ["a", "a", "a", "z", None]
    assert [r[0] for r in rows.select(text.mapped(F.col("x"))).collect()] == ["a", "b", "c", "z", None]
