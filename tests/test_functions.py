import datetime
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from orderloom.functions import dates, numbers, similarity, text
from orderloom.operators import extraction


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'date' if isinstance(v, datetime.date) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x if names else None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_ratio_against_dynamic_programming(spark):
    rng = random.Random(3)
    words = ["", "a", "fourme", "forme"] + ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 12))) for _ in range(12)]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        total = len(r.a) + len(r.b)
        assert r.r == pytest.approx(200 * lcs(r.a, r.b) / total if total else 100.0), (r.a, r.b)


@pytest.mark.parametrize(("a", "b", "ratio"), [(["red", "ring"], ["red", "ring", "small"], 100.0), ([], ["a"], 0.0), (["a"], ["a"], 100.0)])
def test_token_set_ratio(spark, a, b, ratio):
    assert one(spark, similarity.token_set_ratio(F.col("a"), F.col("b")), a=a, b=b) == ratio


def test_accents_as_python_strips_them(spark):
    words = ["Éàü ñ Çà", "Œuf ß ø", "crème brûlée", "ẤẶ", "éte"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.strip_accents(F.col("w")).alias("x")).collect()
    want = ["".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in words]
    assert [r.x for r in got] == want


@pytest.mark.parametrize(("given", "want"), [("  L'Été, à 10h ", "l ete a 10h"), ("", ""), (None, ""), ("œuf", "uf")])
def test_canonical(spark, given, want):
    assert one(spark, text.canonical(F.col("t")), t=given) == want


def test_windows_cover_all_words(spark):
    for n in (0, 1, 41, 42, 43, 70, 71, 200):
        words = [f"w{i}" for i in range(n)]
        got = one(spark, text.windows(F.col("t")), t=words) if n else one(spark, text.windows(F.col("t")), t=[])
        assert [w for i, x in enumerate(got) for w in (x if i == 0 else x[14:])] == words


@pytest.mark.parametrize(("given", "want"), [("06 12 34 56 78", "0612345678"), ("+33 6 12 34 56 78", "0612345678"), ("0033612345678", "0612345678"), ("612345678", "0612345678"), ("123", None), (None, None)])
def test_phone(spark, given, want):
    assert one(spark, numbers.phone(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("1,50", "1.5"), ("-0", "0"), ("10", "10"), ("x", None), ("100.000", "100")])
def test_canonical_decimal(spark, given, want):
    assert one(spark, numbers.canonical_decimal(F.col("t")), t=given) == want


@pytest.mark.parametrize(("q", "want"), [(2.5, 2.5), (1.96, 2.0), (2.04, 2.0), (0.3333, 0.333)])
def test_commercial(spark, q, want):
    assert one(spark, numbers.commercial(F.col("q")), q=q) == want


@pytest.mark.parametrize(("said", "days"), [("pour demain", 1), ("apres demain merci", 2), ("lundi ou mardi", 7), ("mercredi", 2), ("rien", None), ("demain ou apres demain", 1)])
def test_named_delivery_date(spark, said, days):
    monday = datetime.date(2024, 1, 1)
    want = monday + datetime.timedelta(days) if days else None
    assert one(spark, dates.named_delivery_date(F.col("t"), F.col("d")), t=said, d=monday) == want


def test_plural_roots(spark):
    got = spark.createDataFrame([(w,) for w in ("tomates", "gas", "oeufs", "riz")], "w string").select(text.root(F.col("w")).alias("x")).collect()
    assert [r.x for r in got] == ["tomat", "gas", "oeuf", "riz"]


def test_partial_ratio(spark):
    rng = random.Random(5)
    words = ["", "a", "fourme"] + ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10))) for _ in range(10)]
    pairs = [(a, b) for a in words for b in words] + [(None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.partial_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        if r.a is None:
            assert r.r is None
            continue
        short, long = sorted((r.a, r.b), key=len)
        pieces = [long[i:j] for i in range(len(long)) for j in range(i + 1, min(i + len(short), len(long)) + 1) if j - i == len(short) or i == 0 or j == len(long)]
        want = max((200 * lcs(short, p) / (len(short) + len(p)) for p in pieces), default=100.0 if not long else 0.0) if short else (100.0 if not long else 0.0)
        assert r.r == pytest.approx(want), (r.a, r.b)
        assert similarity.lcs_bits(r.a, r.b) == lcs(r.a, r.b)


@pytest.mark.parametrize(("said", "label", "fit"), [("500 g", "beurre 0,5 kg", 12.0), ("500 g", "lait 1 l", -12.0), ("1 l", "creme 1.5 l", -9.0), ("1 l", "pain", 0.0)])
def test_physical_fit(spark, said, label, fit):
    assert one(spark, numbers.physical_fit(numbers.measures(F.col("s"))[0], numbers.measures(F.col("l"))), s=said, l=label) == pytest.approx(fit)


def test_decimals_and_calendar(spark):
    assert one(spark, extraction.spoken_decimals(F.col("t")), t="2 kilos 5 de pain et 3 litres 25") == "2.5 kilos de pain et 3.25 litres"
    assert one(spark, extraction.spoken_decimals(F.col("t")), t="2 kilos 5 cartons") == "2 kilos 5 cartons"
    assert one(spark, extraction.without_calendar(F.col("t")), t="pour lundi le 12 mars") == "pour lundi"
