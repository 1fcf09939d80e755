import math
import zlib
from collections import Counter

import pytest
from orderloom.llm import katz
from pyspark.sql import functions as F

from .conftest import EDGES


class Brute:
    """Katz backoff over tuples of words, from its definition."""

    def __init__(self, texts, order, upto=5):
        self.order, self.upto = order, upto
        self.c = [Counter() for _ in range(order + 1)]
        for t in texts:
            words = ["<s>"] * (order - 1) + (t or "").encode().lower().split() + ["</s>"]
            for i in range(order - 1, len(words)):
                for m in range(1, order + 1):
                    self.c[m][tuple(words[i - m + 1 : i + 1])] += 1
        self.h = [Counter() for _ in range(order + 1)]
        for m in range(1, order + 1):
            for g, n in self.c[m].items():
                self.h[m][g[:-1]] += n
        self.d = [None]
        for m in range(1, order + 1):
            of = Counter(self.c[m].values())
            self.d.append(katz.discounts([0, 0, *[of[r] for r in range(1, upto + 2)]], upto))
        self.vocabulary = [g[0] for g in self.c[1]]

    def mass(self, m, n):
        return n * (self.d[m][n] if n <= self.upto else 1.0)

    def seen(self, m, h):
        return [g for g in self.c[m] if g[:-1] == h]

    def total(self, m, h):
        n = self.h[m][h]
        return n + (n - sum(self.mass(m, self.c[m][g]) for g in self.seen(m, h)) <= 1e-9 * n)

    def p(self, w, h):
        m = len(h) + 1
        n = self.c[m][(*h, w)]
        if n:
            return self.mass(m, n) / self.total(m, h)
        left = lambda: 1 - sum(self.mass(m, self.c[m][g]) for g in self.seen(m, h)) / self.total(m, h)
        if m == 1:
            return left()
        if not self.h[m][h]:
            return self.p(w, h[1:])
        return left() / (1 - sum(self.p(g[-1], h[1:]) for g in self.seen(m, h))) * self.p(w, h[1:])

    def score(self, t):
        words = ["<s>"] * (self.order - 1) + (t or "").encode().lower().split() + ["</s>"]
        return sum(math.log10(self.p(words[i], tuple(words[i - self.order + 1 : i]))) for i in range(self.order - 1, len(words)))


TEXTS = ["a b c a b", "a b a b a b c", "", None, "c c c A", "the cat sat on the mat", "the cat ran on the mat", "a", "b a c", "the dog sat"] * 2 + ["new words the cat", "a b x", "zz zz"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_the_definition(spark, order):
    rows = [(i, t, i < 20) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    brute = Brute(TEXTS[:20], order)
    for size in (8, 1 << 20):
        got, tables = katz.score_texts(docs, F.col("train"), order=order, batch_tokens=size, bucket_tokens=16)
        got = got.collect()
        assert len(got) == len(rows)
        assert tables.select("m").distinct().count() == order
        n, v = sum(brute.c[1].values()), len(brute.c[1])
        for r in got:
            words = [*(TEXTS[r.doc_id] or "").encode().lower().split(), "</s>"]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(brute.c[1][(w,)] > 0 for w in words), n, r.doc_id >= 20)
            assert r.base_score == pytest.approx(sum(math.log10((brute.c[1][(w,)] + 1) / (n + v + 1)) for w in words))
            assert r.score == pytest.approx(brute.score(TEXTS[r.doc_id]), rel=1e-9), TEXTS[r.doc_id]


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up(order):
    brute = Brute(TEXTS[:20], order)
    for m in range(1, order + 1):
        for h in list(brute.h[m]) + [("never",) * (m - 1)]:
            assert sum(brute.p(w, h) for w in [*brute.vocabulary, "unknown"]) == pytest.approx(1.0), h


def test_query_splits_by_crc_and_beats_the_base(spark, sf):
    got = katz.op1_katz(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert held
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges_and_nothing(spark, edges, nothing):
    scored = katz.score_texts(edges, F.col("doc_id") > 2)[0].collect()
    assert len(scored) == len(EDGES)
    assert all(math.isfinite(r.score) for r in scored)
    assert {r.n_tokens for r in scored if r.doc_id in (1, 2, 8)} == {1}
    assert all(r.score == 0 for r in katz.score_texts(edges, F.lit(False))[0].collect())
    assert katz.score_texts(nothing, F.lit(True))[0].count() == 0


def test_keys_survive_packing():
    import numpy as np

    for keys in ([], [5], [0, 1, 2**64 - 1], sorted(hash(str(i)) % 2**64 for i in range(1000))):
        array = np.array(keys, np.uint64)
        assert katz.unpacked(katz.packed(array)).tolist() == array.tolist()
