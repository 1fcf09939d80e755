import random

import xxhash
from orderloom.llm import simhash
from orderloom.llm.components import components
from pyspark.sql import functions as F

from .conftest import EDGES


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, radius):
    at = list(range(len(prints)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius and find(i) != find(j):
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(prints))


def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = grouped([(r.doc_id, fingerprint(r.text)) for r in docs], 3)
    assert sorted(map(tuple, simhash.op2_simhash(spark, sf).collect())) == want


def test_every_pair_within_the_radius_shares_a_masked_key():
    rng = random.Random(1)
    for radius in (1, 3, 6):
        masks = simhash.covering_masks(radius)
        for _ in range(300):
            differing = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & differing == 0 for m in masks)


def test_links_of_dense_buckets(spark):
    """Fingerprints of which very many share buckets: small and blockwise comparison give the components of all pairs."""
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(60)}
    prints |= {centres[0] ^ (x << 20) for x in range(200)}
    rows = list(enumerate(prints))
    df = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in rows], "doc_id long, sig array<long>")
    got = simhash.group_near(df, F.col("sig"), (3,))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(d, c) for d, _, c in grouped(rows, 3)]


def test_edges_and_nothing(edges, nothing):
    got = simhash.group_near(edges, simhash.signatures(3)(F.col("text")), (3,))
    want = grouped([(r[0], fingerprint(r[1][:60] if r[1] and len(r[1]) > 1000 else r[1])) for r in EDGES if not (r[1] and len(r[1]) > 1000)], 3)
    assert sorted((r.doc_id, r.component_id) for r in got.collect() if r.doc_id not in (5, 6)) == [(d, c) for d, _, c in want]
    assert {r.component_id for r in got.collect() if r.doc_id in (5, 6)} == {5}
    assert simhash.group_near(nothing, simhash.signatures(3)(F.col("text")), (3,)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def test_stage_keeps_one_of_near_copies(spark, sf):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(500)) for _ in range(300)) for _ in range(5)]
    rows = []
    for i, text in enumerate(base):
        words = text.split()
        rows += [(10 * i + 1, text), (10 * i + 2, text), (10 * i + 3, " ".join(words[:150] + ["changed"] + words[151:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.simhash_stage(spark, docs, sf).collect()) == [1, 11, 21, 31, 41]


def test_masks_keep_about_half_of_the_bits():
    for radius in range(1, 7):
        kept = [m.bit_count() for m in simhash.covering_masks(radius)]
        assert len(kept) == 2 ** (radius + 1) - 1
        assert min(kept) >= 30
