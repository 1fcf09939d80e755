import random

import pytest
from orderloom.llm import shingles, simhash


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, n, kind, least):
    """A text of n words, and a copy with words appended, cut off or replaced in one place, or scattered, of a similarity just over `least`."""
    fresh = lambda k: [rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(500)) for _ in range(k)]
    words, best = fresh(n), None
    places, more = rng.sample(range(n), n), fresh(n)
    for k in range(1, n // 3):
        copy = {"appended": words + more[:k], "cut": words[:-k], "replaced": words[: n // 3] + more[:k] + words[n // 3 + k :], "scattered": [more[i] if i in set(places[:k]) else w for i, w in enumerate(words)]}[kind]
        if jaccard(" ".join(words), " ".join(copy)) < least:
            break
        best = copy
    return " ".join(words), " ".join(best)


@pytest.mark.parametrize("kind", ["appended", "cut", "replaced", "scattered"])
def test_copies_edited_in_one_place_go(spark, sf, kind):
    rng = random.Random(5)
    pairs = [edited(rng, n, kind, least) for n in (120, 200, 300, 500) for least in (0.8, 0.85, 0.9) for _ in range(3)]
    docs = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.simhash_stage(spark, docs, sf).collect()) == [2 * i for i in range(len(pairs))]


def test_groups_against_all_pairs(spark, monkeypatch):
    """Chains about the threshold, in small buckets and in blocks: components of all pairs of 0.8 or more, and no others."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = random.Random(6)
    texts = []
    for _ in range(4):
        words = [f"{rng.randrange(10**6)}" for _ in range(90)]
        for i in range(30):
            at = rng.randrange(90 - 8)
            texts.append(" ".join(words[:at] + [f"n{i}x{j}" for j in range(rng.randrange(1, 12))] + words[at + rng.randrange(8) :]))
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    got = shingles.group_alike(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(want))


def test_edges_and_nothing(edges, nothing):
    got = sorted((r.doc_id, r.component_id) for r in shingles.group_alike(edges).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (7, 7), (8, 1), (9, 9), (10, 10), (11, 3)]
    assert shingles.group_alike(nothing).count() == 0
