"""The near-dedup stage finds its candidates by SimHash fingerprints."""

import random

import numpy as np
import pytest
from orderloom.llm import shingles, simhash
from orderloom.llm.words import wide_majority


@pytest.mark.parametrize("fewer, more", [(4, 5), (12, 15), (80, 100), (400, 500)])
def test_tables_reach_pairs_of_the_threshold(fewer, more):
    rng, size = np.random.default_rng(more), shingles.key_bits(1000)
    for _ in range(40):
        hashes = rng.integers(0, 2**48, more, dtype=np.uint64)
        prints = np.stack([wide_majority(x, shingles._SALTS) for x in (hashes, hashes[:fewer])])
        keys = shingles.table_keys(prints, size, range(shingles.n_tables(size)))
        assert (keys[0] == keys[1]).any()
        for bits in (shingles.GATE_BITS, shingles.BITS):
            assert np.bitwise_count(prints[0, : bits // 8] ^ prints[1, : bits // 8]).sum() <= shingles.reach(bits)


def test_wide_fingerprint_is_a_vote_on_each_bit():
    hashes = np.arange(600, dtype=np.uint64) * np.uint64(977)
    mixed = [np.stack([wide_majority(hashes[i : i + 1], shingles._SALTS) for i in range(n)]) for n in (1, 2, 600)]
    for some in mixed:
        votes = np.unpackbits(some, axis=1, bitorder="little").sum(axis=0)
        got = np.unpackbits(wide_majority(hashes[: len(some)], shingles._SALTS), bitorder="little")
        assert (got == (2 * votes > len(some))).all()


def test_stage_goes_by_fingerprints(spark, sf, monkeypatch):
    """The same near copies go or stay with the number of bits that fingerprints may differ in."""
    rng = random.Random(8)
    words = [f"{rng.randrange(10**6)}" for _ in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:185])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.simhash_stage(spark, docs, sf).collect()) == [1, 3]
    monkeypatch.setattr(shingles, "reach", lambda bits: 0)
    assert sorted(r.doc_id for r in simhash.simhash_stage(spark, docs, sf).collect()) == [1, 2, 3]
