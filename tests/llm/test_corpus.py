import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from orderloom.llm import decontam, mixing, quality
from pyspark.sql import functions as F

from .conftest import EDGES

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def windows_with(doc, item, similarity):
    d, i = decontam.plain_words(doc.encode()), decontam.plain_words(item.encode())
    size = min(5, len(i))
    grams = lambda w: Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    return max((decontam.weighted_similarity(grams(d[s : s + len(i)]), grams(i)) for s in range(max(len(d) - len(i), 0) + 1)), default=0.0) if i and len(d) >= size else 0.0


def test_leaks_against_all_windows(spark):
    rng = random.Random(7)
    items = [(k, " ".join(sentence(rng, n))) for k, n in enumerate([3, 5, 12, 20, 35, 60, 90, 140])] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for k, text in items[:8]:
        w = text.split()
        docs.append(" ".join(sentence(rng, 30) + w + sentence(rng, 30)))
        docs.append(", ".join(sentence(rng, 9)) + "\n" + text.upper() + "!")
        changed = list(w)
        for _ in range(max(1, len(w) // 60)):
            changed[rng.randrange(len(w))] = "CHANGED"
        docs.append(" ".join(sentence(rng, 5) + changed + sentence(rng, 5)))
        docs.append(" ".join(w[: len(w) // 2]))
        docs.append(text)
    docs += [" ".join(sentence(rng, 200)) for _ in range(10)]
    table = spark.createDataFrame(list(enumerate(docs)) + [(900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, k): windows_with(t, i, 0.8) for d, t in enumerate(docs) for k, i in items[:8]}
    want = {pair: s for pair, s in want.items() if s >= 0.8}
    for block in (20_000, 3):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(table, bench, block_items=block).collect()}
        assert got.keys() == want.keys()
        assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_every_fingerprint_within_the_radius_is_found():
    rng = random.Random(8)
    items = decontam.Items([(k, " ".join(sentence(rng, 30))) for k in range(900)], 15)
    import numpy as np

    for k in range(0, 900, 30):
        prints = np.array([int(items.prints[k]) ^ sum(1 << b for b in rng.sample(range(64), n)) for n in range(16)], np.uint64)
        assert {(w, k) for w in range(16)} <= items.within(30, prints)


def test_leaks_on_edges_and_nothing(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "Same text here"), (2, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(edges, bench).collect()) == [(3, 1), (4, 1), (11, 1)]
    assert decontam.find_leaks(nothing, bench).count() == 0
    assert decontam.find_leaks(edges, bench.limit(0)).count() == 0


def test_planted_items_are_found(spark, sf):
    norm = lambda t: " ".join((t or "").split())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    planted = {(d.doc_id, i.item_id) for d in docs for i in items if norm(i.text) in norm(d.text)}
    assert planted <= {(r.doc_id, r.item_id) for r in decontam.op4_decontamination(spark, sf).collect()}


def test_mix_hits_its_targets(spark, sf):
    got = mixing.op6_mix(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        source = docs[r.doc_id].source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target

    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    assert sum(target.values()) == pytest.approx(min(sum(sizes.values()), 3 * sum(sizes.values())))
    for k, s in enumerate(order):
        assert target[s] <= 3 * sizes[s] + 1e-6
        assert taken[s] == round(target[s]), (s, k)


def laid_out(rows, shuffle, weights=(1, 2, 3), epochs=3, block=256):
    """Words taken of each (id, text, source), by walking through the schedule slot by slot and the streams word by word."""
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    whole = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, free = {}, float(sum(whole.values())), list(sources)
    while stops := [s for s in free if epochs * whole[s] <= left * weight[s] / sum(weight[x] for x in free)]:
        s = min(stops, key=lambda s: epochs * whole[s] / weight[s])
        target[s] = epochs * whole[s]
        left -= target[s]
        free.remove(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    stream = {s: [i for _ in range(epochs) for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: shuffle[rows[i][0]]) for _ in range(size(rows[i][1]))] for s in sources}
    total, taken, used = sum(whole.values()), Counter(), Counter()
    bounds, upto = [], 0.0
    for s in sources:
        upto += target[s] / total
        bounds.append((upto, s))
    bounds[-1] = (2.0, bounds[-1][1])

    def slot(s):
        words = stream[s][used[s] * block : min((used[s] + 1) * block, round(target[s]))]
        taken.update(words)
        used[s] += 1

    for i in range(-(-total // block)):
        slot(next(s for high, s in bounds if ((i >> 16) * mixing.GOLDEN_HIGH + (i & 0xFFFF) * mixing.GOLDEN + 0.5) % 1 < high))
    for s in sources:
        while used[s] * block < round(target[s]):
            slot(s)
    return [(i, size(t), whole[s], target[s], taken[k]) for k, (i, t, s) in enumerate(rows)]


@pytest.mark.parametrize("block", [1, 16, 256, 4096])
def test_mix_against_the_schedule(spark, block):
    rng = random.Random(15)
    sizes = {"a": 40, "b": 3, "c": 1, "d": 20, None: 5}
    rows = [(i, " ".join(sentence(rng, rng.randrange(0, 90))) or None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(900, "one two", "e"), (901, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shuffle = {r.doc_id: r.h for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 52).alias("b"), F.xxhash64(F.lit("mix"), "doc_id").alias("x")).select("doc_id", F.struct("b", "x").alias("h")).collect()}
    got = mixing.mix(df, block_words=block).collect()
    want = laid_out(rows, shuffle, block=block)
    assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == sorted((i, n, w, k) for i, n, w, _, k in want)
    assert {r.doc_id: r.target for r in got} == pytest.approx({i: t for i, _, _, t, _ in want})


def test_mix_is_the_same_on_any_partitioning(spark, edges, nothing):
    first = sorted(map(tuple, mixing.mix(edges).collect()), key=repr)
    assert sorted(map(tuple, mixing.mix(edges.repartition(7)).collect()), key=repr) == first
    assert len(first) == len(EDGES)
    assert mixing.mix(nothing).count() == 0


def test_quality_tells_held_out_documents(spark):
    """Labels of every second labelled document are kept from the classifier; it is judged on those."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    held = got.join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").collect()
    counts = defaultdict(Counter)
    for r in held:
        counts[r.quality, r.toxic][r.kept] += 1
    share = lambda c: c[True] / c.total()
    assert share(counts[1, 0]) > 0.98
    assert share(counts[0, 0]) < 0.1
    assert share(counts[0, 1]) < 0.1
    assert share(counts[1, 1]) < 0.35


def named_features(text):
    """The features of a text by name: n-gram and power of two."""
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    pairs = ["same" if a == b else (a, b) for a, b in zip(tokens, tokens[1:], strict=False)]
    return {(kind, g, level) for kind, grams in (("one", tokens), ("two", pairs)) for g, n in Counter(grams).items() for level in range(n.bit_length())}


def log_posterior_ratio(own, every, share, prior=4.0, differs=0.01):
    rising = lambda start, n: math.lgamma(start + n) - math.lgamma(start)
    evidence = rising(prior * share, own) + rising(prior * (1 - share), every - own) - rising(prior, every) - own * math.log(share) - (every - own) * math.log(1 - share)
    odds = differs / (1 - differs) * math.exp(evidence)
    return (1 + odds * (own + prior * share) / ((every + prior) * share)) / (1 + odds)


def test_quality_against_its_definition(spark):
    rng = random.Random(12)
    kinds = {(1, 0): WORDS[:6], (0, 0): [w + "!!" for w in WORDS[:6]], (1, 1): WORDS[:6] + ["scum"] * 6}
    rows, marks = [], []
    for i in range(240):
        mark = rng.choices(list(kinds), (6, 2, 1))[0]
        words = [rng.choice(kinds[mark]) for _ in range(rng.randrange(4, 60))]
        rows.append((i, " ".join(words + words[-1:] * rng.choice((0, 0, 3)))))
        if i % 2:
            marks.append((i, *mark))
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()

    part = {i: {(1, 0): 0, (0, 0): 1, (1, 1): 2}[q, t] for i, q, t in marks}
    texts = dict(rows)
    counts = [Counter(f for i, j in part.items() if j == k for f in named_features(texts[i])) for k in range(3)]
    every = counts[0] + counts[1] + counts[2]
    total, n = every.total(), [sum(j == k for j in part.values()) for k in range(3)]
    ratio = [{f: log_posterior_ratio(counts[k][f], every[f], counts[k].total() / total) for f in every} for k in range(3)]
    unseen = 2 * quality.BUCKETS - len(every)
    rates = total + 2 * quality.BUCKETS
    level = [math.log((sum(ratio[k][f] * (every[f] + 1) for f in every) + unseen) / rates) for k in range(3)]
    score = lambda t, k: sum(math.log(ratio[k].get(f, 1)) - level[k] - math.log(ratio[0].get(f, 1)) + level[0] for f in named_features(t))
    scores = {i: [score(t, 1), score(t, 2)] for i, t in rows}

    half = lambda x: max(-40.0, min(40.0, round(2 * x) / 2))
    share = [x / sum(n) for x in n]
    for _ in range(100):
        sums = list(map(float, n))
        for s in scores.values():
            p = [w * math.exp(x) for w, x in zip(share, (0.0, *map(half, s)), strict=True)]
            sums = [a + b / sum(p) for a, b in zip(sums, p, strict=True)]
        share = [x / sum(sums) for x in sums]
    for r in got:
        over = share[0] + share[1] * math.exp(scores[r.doc_id][0]) + share[2] * math.exp(scores[r.doc_id][1])
        assert r.log_weight == pytest.approx(-math.log(over), abs=1e-3), r
        assert r.target_probability == pytest.approx(share[0] / over, abs=2e-3)
    # the draw: Gumbel variates over log weights, the k largest keys
    k = round(1.02 * sum(r.target_probability for r in got))
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.sample_key)[:k]}
    noise = sorted(r.sample_key - r.log_weight for r in got)
    assert max(abs(math.exp(-math.exp(-x)) - (i + 0.5) / len(noise)) for i, x in enumerate(noise)) < 0.11


def test_the_kth_key_of_any_keys(spark):
    rng = random.Random(13)
    keys = [rng.choice((-1, 1)) * rng.randrange(1 << rng.randrange(1, 42)) for _ in range(500)] + [5] * 40
    df = spark.createDataFrame([(x,) for x in keys], "key long")
    for k in (1, 2, 250, 300, 540):
        assert quality._kth(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality._kth(df, 0) is None


def test_quality_on_edges_and_nothing(spark, edges, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (9, None, 0), (7, 1, 1), (7, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(edges, labels).count() == len(EDGES)
    assert quality.classify(edges, labels.limit(0)).where("kept").count() == len(EDGES)
    assert quality.classify(nothing, labels).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, left, sf), "stage")
        assert after.columns == docs.columns + ["size", "source_size", "target", "taken"] * (name == corpus_pipeline.STAGES[-1][0]), name
        assert after.count() <= left.count()
        assert after.join(left, "doc_id", "left_anti").count() == 0
        left = after
    assert 0.5 * docs.count() < left.count() < docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, left.collect()))


#: Columns whose names stages use themselves, and one of a type that can be neither compared nor hashed.
CLASHES = {"n_lines": "7", "n_dropped": "8", "lines": "'l'", "h1": "1", "pos": "2", "kept_id": "3", "text_hash": "4", "component_id": "5", "taken": "6", "place": "'p'", "id": "9", "bucket": "'b'", "item": "null", "of_id": "10", "tags": "map('k', 1)", "__s": "11", "__fixed": "12", "__kept": "13", "Weight": "14", "KEPT": "15", "Hash": "16"}


def stage_input(edges):
    return edges.select("*", *[F.expr(x).alias(c) for c, x in CLASHES.items()])


def plain_rows(df, columns=None):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_line_stage_on_edges(spark, sf, edges):
    rows = stage_input(edges)
    got = corpus_pipeline.line_stage(spark, rows, sf)
    assert got.columns == rows.columns
    want = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    assert plain_rows(got) == plain_rows(want)
    often = spark.createDataFrame([(i, f"own {i}\nshared") for i in range(10)], "doc_id long, text string")
    assert plain_rows(corpus_pipeline.line_stage(spark, stage_input(often), sf), ["doc_id", "text", "n_lines"]) == [(i, f"own {i}", 7) for i in range(10)]


def test_near_dedup_stage_on_edges(spark, sf, edges):
    rows = stage_input(edges)
    got = corpus_pipeline.simhash_stage(spark, rows, sf)
    assert got.columns == rows.columns
    assert plain_rows(got, ["doc_id"]) == [(1,), (10,), (3,), (5,), (7,), (9,)]
    assert {(r.doc_id, r.text, r.key, r["size"], r.kept_id, r.tags["k"]) for r in got.collect() if r.doc_id in (1, 7)} == {(1, None, "a", 1, 3, 1), (7, "repeated row", "x", 7, 3, 1)}
    # no ids, ids that repeat with other texts, and rows that agree in id and text but not in the rest
    some = [(None, "one two three", "a"), (None, "four five", "a"), (1, "six seven", "b"), (1, "eight nine", "b"), (2, "ten", "d"), (2, "ten", "c")]
    got = corpus_pipeline.simhash_stage(spark, stage_input(spark.createDataFrame(some, "doc_id long, text string, source string")), sf)
    assert plain_rows(got, ["doc_id", "text", "source"]) == sorted([x for x in some if x[2] != "d"], key=repr)


def test_decontamination_stage_on_edges(spark, tmp_path, edges):
    spark.createDataFrame([(1, "Same text here"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = stage_input(edges).unionByName(stage_input(edges).where("doc_id in (3, 9)").withColumn("doc_id", F.lit(None).cast("long")))
    got = corpus_pipeline.decontamination_stage(spark, rows, str(tmp_path))
    assert got.columns == rows.columns
    assert plain_rows(got, ["doc_id", "text"]) == plain_rows(rows.where("doc_id is null and text not like 'Same%' or doc_id is not null and doc_id not in (3, 4, 11)"), ["doc_id", "text"])


def test_quality_stage_on_edges(spark, tmp_path, edges):
    rows = stage_input(edges)
    spark.createDataFrame([(3, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.quality_stage(spark, rows, str(tmp_path))
    assert got.columns == rows.columns
    assert plain_rows(got) == plain_rows(rows)  # one kind of label tells nothing: all stay


def test_mixing_stage_on_edges(spark, sf, edges):
    rows = stage_input(edges)
    got = corpus_pipeline.mixing_stage(spark, rows, sf)
    kept = [c for c in rows.columns if c not in ("size", "taken")]
    assert got.columns == [*kept, "size", "source_size", "target", "taken"]
    assert plain_rows(got, kept) == plain_rows(rows, kept)
    assert plain_rows(got, ["doc_id", "size", "source_size", "target", "taken"]) == plain_rows(mixing.mix(edges), ["doc_id", "size", "source_size", "target", "taken"])
    null = rows.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.mixing_stage(spark, null.unionByName(null), sf).count() == 2


def test_stages_on_nothing(spark, sf, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stage_input(nothing), sf).count() == 0


def test_a_long_text_of_hits_takes_little_memory():
    """A text of 2 MB that is nearly all benchmark: what it takes beside its own words is bounded by windows at once."""
    import tracemalloc

    rng = random.Random(16)
    texts = [" ".join(sentence(rng, n)) for n in (12, 40, 90)]
    items = decontam.Items(list(enumerate(texts)), 15)
    text = "\n".join(rng.choice(texts) + " " + " ".join(sentence(rng, 3)) for _ in range(7000)).encode()
    tracemalloc.start()
    found = items.leaks(text, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(x[0] for x in found) == [0, 1, 2]
    assert most < 40 * len(text)


def test_radius_keeps_pairs_of_the_similarity():
    """Of items and windows that agree in 0.8 or more the radius finds nine in ten and more, in each band; figures are in the README."""
    rng = random.Random(17)
    seen, found = Counter(), Counter()
    for _ in range(1500):
        n = rng.choice((20, 40, 80))
        item, window = sentence(rng, n), None
        window = list(item)
        for _ in range(rng.choice((1, 1, 2, 3))):
            window[rng.choice((0, n - 1, rng.randrange(n)))] = "other"
        one = decontam.Items([(0, " ".join(item))], 64)
        for _, s, _, _, bits in one.leaks(" ".join(window).encode(), 0.8):
            band = min(int(s * 20), 19)
            seen[band] += 1
            found[band] += bits <= 15
    assert all(found[b] >= 0.9 * seen[b] for b in seen), [(b / 20, seen[b], found[b]) for b in sorted(seen)]
    print([(b / 20, seen[b], round(found[b] / seen[b], 3)) for b in sorted(seen)])
