import hashlib
import re
from collections import defaultdict

from orderloom.llm.exact_dedup import exact_dedup
from orderloom.llm.line_dedup import line_dedup
from pyspark.sql import functions as F

from .conftest import EDGES

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_dedup_on_edges(spark, edges):
    groups = defaultdict(list)
    for row in EDGES:
        groups[SPACE.sub(" ", row[1] or "")].append(row[0])
    want = sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(map(tuple, exact_dedup(edges, block_chars=7).collect())) == want
    assert sorted(map(tuple, exact_dedup(edges).collect())) == want


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup(nothing).collect() == []


def test_texts_that_share_blocks_but_differ(spark):
    texts = ["a" * 20 + "b", "a" * 20 + "c", "a" * 21, "a" * 20 + "b", "b" + "a" * 20, "a" * 10, "a" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup(df, block_chars=5).collect()}
    assert got == {i: texts.index(t) for i, t in enumerate(texts)}


def dropped(rows, least, min_chars=1):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    have = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            have[key(line)].add(n)
    often = {k for k, v in have.items() if len(v) >= least and len(k) >= min_chars}
    return sorted((i, "\n".join(x for x in (t or "").split("\n") if key(x) not in often), len((t or "").split("\n")), sum(key(x) in often for x in (t or "").split("\n"))) for i, t in rows)


def test_line_dedup_against_counting(spark):
    rows = [(i, "\n".join(["Shared line ", f"own {i}", "SHARED LINE", "", f"half {i % 2}", "x"][: 2 + i % 5])) for i in range(12)] + [(20, None), (21, ""), (22, " \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(1)).withColumn("pos", F.lit(2))
    for least, chars in ((3, 1), (5, 2), (100, 1)):
        got = line_dedup(df, min_docs=least, min_chars=chars)
        assert got.columns == [*df.columns, "n_lines", "n_dropped"]
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == dropped(rows, least, chars)


def test_line_dedup_on_edges_and_nothing(edges, nothing):
    assert line_dedup(edges).count() == len(EDGES)
    assert line_dedup(nothing).count() == 0
