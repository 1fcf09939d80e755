import random
from collections import defaultdict

import numpy as np
import pytest
from orderloom.llm import substring_dedup as module
from orderloom.llm.substring_dedup import NO_ID, Phrases, Piece, anchors, runs, substring_dedup, words_at

from .conftest import EDGES


def plainly(docs, window):
    """docs: (id, text). The contract by a table of all windows."""
    split = lambda t: (t or "").encode().split()
    at = lambda i: NO_ID if i is None else i
    least = {}
    for i, t in docs:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, NO_ID), at(i))
    found = []
    for i, t in docs:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < at(i):
                gone |= set(range(k, k + window))
        found.append((at(i), len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(found)


def deduped(spark, docs, window):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(df, window=window).collect())


def copied(rng, n, words, longest):
    """Texts that take passages from each other, of random words."""
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            if texts and rng.random() < 0.6:
                w = rng.choice(texts).split()
                a = rng.randrange(len(w)) if w else 0
                parts += w[a : a + rng.randint(1, longest)]
            else:
                parts += [rng.choice(words) for _ in range(rng.randint(0, longest))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in parts))
    return texts


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_against_all_windows(spark, window):
    rng = random.Random(window)
    words = [f"w{i}" for i in range(3 if window > 2 else 400)] + ["é", "😀x", "The", "the"]
    docs = [(rng.choice([None, *range(60)]), t) for t in copied(rng, 90, words, 40)] + [(70, None), (71, ""), (72, " \n")]
    assert deduped(spark, docs, window) == plainly(docs, window)


def test_small_blocks_automata_and_shares(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_WORDS", 7)
    monkeypatch.setattr(module, "AUTOMATON", 3)
    monkeypatch.setattr(module, "SHARE", 5)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(2500))  # more than one passage's windows
    texts = copied(rng, 60, [f"w{i}" for i in range(30)], 60) + [f"a{i} {passage} b{i}" for i in range(3)]
    docs = list(enumerate(texts))
    assert deduped(spark, docs, 13) == plainly(docs, 13)


def test_exact_and_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(9999)}" for _ in range(300)]
    docs = [(i, " ".join(base)) for i in range(40)] + [(40 + i, " ".join([*base[: 7 * i], "new", *base[7 * i + 1 :]])) for i in range(40)]
    got = deduped(spark, docs, 13)
    assert got == plainly(docs, 13)
    assert [r[2] for r in got[:40]] == [0] + [300] * 39


def test_word_hashes_do_not_depend_on_the_place():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    words = [word() for _ in range(400_000)] + ["x" * (3 * module.CHUNK)] + [word() for _ in range(1000)]
    text = ("\n" + " \t".join(words)).encode()
    assert len(text) > 3 * module.CHUNK
    starts, ends, hashes = words_at(text)
    assert [text[s:e] for s, e in zip(starts, ends, strict=True)] == text.split()
    by_word = defaultdict(set)
    for w, h in zip(words, hashes.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({h for v in by_word.values() for h in v}) == len(by_word)
    assert words_at(("x" * (3 * module.CHUNK)).encode())[2][0] == hashes[400_000]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    twice = np.concatenate([hashes[100:200], hashes, hashes[50:120]])
    for window in (1, 2, 13):
        size = (window + 1) // 2
        found, short = anchors(twice, window), runs(twice, size)
        assert found.tolist() == [min(short[k : k + window - size + 1].tolist()) for k in range(len(twice) - window + 1)]
        of = defaultdict(set)
        for key, anchor in zip(runs(twice, window).tolist(), found.tolist(), strict=True):
            of[key].add(anchor)
        assert all(len(v) == 1 for v in of.values())
    assert len(anchors(hashes[:5], 13)) == 0


def test_texts_of_a_piece_stay_apart():
    texts = [b"a b c", b"", b" c d ", b"e", b"\t", b"a b c d"]
    piece = Piece(texts, 2)
    assert [piece.text[s:e] for s, e in zip(piece.starts, piece.ends, strict=True)] == b" ".join(texts).split()
    assert piece.row.tolist() == [0, 0, 0, 2, 2, 3, 5, 5, 5, 5]
    assert piece.whole.tolist() == [True, True, False, True, False, False, True, True, True]
    assert piece.place[piece.whole].tolist() == [0, 1, 0, 0, 1, 2]
    assert not len(Piece([b"", b""], 13).whole)


def test_automaton_locates_every_occurrence():
    phrases = Phrases(3)
    phrases.add(b"a b c d", 4)
    phrases.add(b"c a b c", 2)
    assert phrases.ready().later(b"x a b c a b c d", 5) == [1, 3, 4, 5]
    assert phrases.later(b"x a b c a b c d", 3) == [1, 3, 4]
    assert Phrases(3).ready().later(b"a b c", 9) == []


def test_edges_clashes_and_nothing(spark, edges, nothing):
    want = plainly([r[:2] for r in EDGES], 13)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(edges).collect()) == want
    names = {"lang": "of_id", "source": "SPANS", "n_chars": "N_Words", "key": "row_hash", "size": "made"}
    found = substring_dedup(edges.withColumnsRenamed(names))
    assert found.columns == ["doc_id", "text", "of_id", "SPANS", "row_hash", "made", "n_words", "n_removed"]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect()) == want
    assert substring_dedup(nothing).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(edges, window=0)
