import random

from orderloom.operators.retrieval import families, merged_lists, query_words
from pyspark.sql import functions as F


def test_lists_are_merged_as_one_by_one(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5), rng.randrange(40), rng.randrange(4), rng.choice([None, 0.5, 1.0, 2.0]), float(rng.randrange(9))) for _ in range(600)]
    got = {}
    for r in merged_lists(spark.createDataFrame(rows, "k int, i int, stage int, major double, minor double").repartition(4), "k", "i", 12).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.i, r.stage))
    for k in range(5):
        chosen, seen = [], set()
        for _, i, stage, _, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], -1 if r[3] is None else r[3], r[4], r[1])):
            if i not in seen and len(chosen) < 12:
                seen.add(i)
                chosen.append((i, stage))
        assert got[k] == chosen


def test_every_query_gets_its_best_before_any_its_second(spark):
    rows = [("m", f"{q}{rank}", 3, float(rank), float(n)) for n, q in enumerate("abc") for rank in range(3)]
    got = merged_lists(spark.createDataFrame(rows, "k string, i string, stage int, major double, minor double"), "k", "i", 5).orderBy("place").collect()
    assert [r.i for r in got] == ["a0", "b0", "c0", "a1", "b1"]


def test_words_of_queries(spark):
    df = spark.createDataFrame([("2 cartons de Cheddars râpés x10 1234 tomes",), (None,)], "q string")
    assert [sorted(r[0]) for r in df.select(query_words(F.col("q"))).collect()] == [["cheddar", "cheddars", "rape", "rapes", "tome", "tomes"], []]


def test_families_by_rare_words(spark):
    catalogue = spark.createDataFrame([(1, "cheddar doux"), (2, "cheddar fort"), (3, "ketchup doux"), (4, "creme 1234"), (5, None), (5, "cheddar fort"), (6, "tome doux")], "i int, label string")
    queries = spark.createDataFrame([("a", "des cheddars"), ("a", "ketchup doux"), ("b", "doux"), ("c", None), ("d", "creme 1234 carton")], "k string, q string")
    found = lambda **x: sorted((r.k, r.i, r.word, r["size"]) for r in families(queries, catalogue, "k", "q", "i", "label", **x).collect())
    ketchup, cheddar, creme = [("a", 3, "ketchup", 1)], [("a", i, "cheddar", 3) for i in (1, 2, 5)], [("d", 4, "creme", 1)]
    assert found() == sorted(cheddar + ketchup + creme + [(k, i, "doux", 3) for k in "ab" for i in (1, 3, 6)])
    assert found(words=1) == sorted(cheddar + ketchup + creme + [("b", i, "doux", 3) for i in (1, 3, 6)])
    assert found(most=2) == ketchup + creme
