import hashlib
import random
import re

import numpy as np
import pytest
from orderloom.llm.fim import SENTINELS, Bits, boundaries, check_sentinels, cut, fill_in_middle, restored
from pyspark.sql import functions as F

from .conftest import EDGES

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text, seed=1):
    """The contract, token by token."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_and_select_against_counting():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for share in (0.0, 0.02, 0.5, 1.0):
            flags = rng.random(size) < share
            bits, ones = Bits(flags), np.flatnonzero(flags)
            assert bits.total() == len(ones)
            assert [bits.select(k) for k in range(len(ones) + 1)] == [*ones.tolist(), size]
            assert [bits.rank(k) for k in range(size + 1)] == [0, *np.cumsum(flags).tolist()]


def test_boundaries_are_those_of_the_expression():
    for text in ("a", "été ÉTÉ 😀x", "\n\n a1b2", "日本語abc", "Zz[`{@a", "\x00 \x7f", "ab" * 900):
        tokens, points = boundaries(text.encode())
        assert tokens.total() == len(TOKEN.findall(text)) and points.total() == len(text)
        starts = [len(text[: m.start()].encode()) for m in TOKEN.finditer(text)]
        assert [tokens.select(k) for k in range(tokens.total())] == starts
    assert cut(b"", 5, 6) == cut(None, 5, 6) == (0, 0, 0, 0, 0)


def rows_for_seams():
    rng = random.Random(5)
    pieces = ["<", "<P", "<S", "<M", ">", "P>", "S>", "M>", "word", " ", "\n", "é", "😀", "<<", "$1", "\\Q"]
    return [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(400)]


def test_outputs_against_the_definition_and_back(spark):
    rows = [*rows_for_seams(), (None, "null id <"), (1000, None), (1001, "x" * 200_000 + " é" * 5000), (1002, "has <P> in it")]
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).withColumn("back", restored(F.col("output"), F.col("form")))
    got = {r.doc_id: r for r in made.collect()}
    forms = set()
    for i, text in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(i, text), text
        assert r.back == (text or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_other_parameters(spark):
    df = spark.createDataFrame(rows_for_seams(), "doc_id long, text string").where("text <> ''")
    every = fill_in_middle(df, plain_percent=0, spm_percent=100, sentinels=("[1]", "[2]", "[3]"), seed=7)
    assert {r.form for r in every.collect()} == {"spm"}
    assert every.where(restored(F.col("output"), F.col("form"), ("[1]", "[2]", "[3]")) != F.col("text")).count() == 0
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "bc", "x"), ("", "a", "b"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            check_sentinels(bad)


def test_edges_clashes_and_nothing(spark, edges, nothing):
    got = sorted((r.doc_id, r.n, r.form, r.prefix_chars or -1, r.middle_chars or -1, r.output) for r in fill_in_middle(edges).collect())
    want = [(i, *plainly(i, t)) for i, t, *_ in EDGES]
    assert got == sorted((i, n, f, p or -1, m or -1, o) for i, n, f, p, m, o in want)
    clash = spark.createDataFrame([(1, "a b c", 5, "x", "y", 7, "t", "d")], "doc_id long, text string, N long, Form string, Output string, key long, of_text string, OF_CUTS string")
    found = fill_in_middle(clash)
    assert found.columns == ["doc_id", "text", "key", "of_text", "OF_CUTS", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert found.first().output == plainly(1, "a b c")[-1]
    assert fill_in_middle(nothing).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(clash, text_col="Output")
