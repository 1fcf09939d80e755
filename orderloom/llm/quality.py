"""Quality classification by importance resampling: target against raw text under hashed n-gram models, Gumbel top-k.

Target is text of good quality that is not toxic. Raw text is a mixture of target and of what the labels tell from it (low
quality; toxic text of good quality), in the shares that all documents together show. Each part is a bag of hashed n-grams: single
words and punctuation runs, pairs of neighbours (a pair of equal words is the same feature whatever the word), and each of
these again for every power of two that it occurs a document; a document has each of its features once.

A part's rate of a feature is the rate in the labelled sample times a ratio. That ratio is one (no difference) or drawn from a
Gamma distribution of mean one and of shape `prior`, the latter with probability `differs` beforehand; its posterior mean is taken.
So a difference that chance explains weighs next to nothing, whatever the number of such features. Rates of a part add up to one.

A document's importance weight is p_target(x) / p_raw(x) = 1 / sum over parts j of share_j * p_j(x) / p_target(x). The
shares come from the labelled sample and from all documents: expectation maximisation over a histogram of the log ratios, of a
bounded number of cells. Documents are drawn without replacement with probability in proportion to weight ** (1 /
temperature): each gets its log weight / temperature plus a Gumbel variate from a hash of its id and text, and the k largest
stay. k is `keep` times the number of documents that the model expects to be target; a little over one, as among equal weights
the draw would else leave out a target for every other text that it takes.

Texts are read once, and nothing of them is shuffled; the k-th key is found from counts of keys by their leading bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, table

_TOKEN = regex.compile(r"\w+|[^\w\s]+", regex.V1)
BUCKETS = 1 << 18
#: Parts of raw text beside the target.
PARTS = ("low", "toxic")
#: Cells of the histogram: log ratios in steps of STEP up to LIMIT on either side.
STEP, LIMIT = 0.5, 40.0
#: Bits of a key that a pass of the selection tells apart, passes, and the fraction bits that a key has.
RADIX, PASSES, FRACTION = 14, 3, 31
_h = xxhash.xxh3_64_intdigest
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SAME = np.uint64(_h(b"a word and the same again"))


def features(text: str | None) -> np.ndarray:
    """The buckets of a text's features, once each: words and punctuation runs in the lower half, neighbours in the upper."""
    tokens = _TOKEN.findall(text) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    one = np.fromiter(map(_h, tokens), np.uint64, len(tokens))
    two = np.where(one[:-1] == one[1:], _SAME, (one[:-1] * _A + one[1:]) * _B)
    found = []
    for half, grams in enumerate((one, two)):
        distinct, often = np.unique(grams, return_counts=True)
        level = np.zeros(len(distinct), np.uint64)
        while len(distinct):
            mixed = (distinct ^ level * _A) * _B
            found.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64) + half * BUCKETS)
            more = often >= 2 << int(level[0])
            distinct, often, level = distinct[more], often[more], level[more] + np.uint64(1)
    return np.unique(np.concatenate(found))


def _count(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of target and of each other part have each feature, and how many documents there are; rows: text, part (0: target)."""
    n_parts = 1 + len(PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts, 2 * BUCKETS + 1), np.int32)
        for b in batches:
            for text, part in zip(b["text"], b["part"].to_pylist(), strict=True):
                sums[part, features(text.as_py())] += 1
                sums[part, -1] += 1
        part, has = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(has), pa.array(sums[part, has])], ["part", "feature", "n"])

    per = rows.mapInArrow(count, "part int, feature long, n int")
    sums = per.groupBy("part", "feature").agg(F.sum("n").cast("int").alias("n")).toArrow()  # bounded by parts times buckets
    counts = np.zeros((n_parts, 2 * BUCKETS + 1))
    counts[sums["part"].to_numpy(), sums["feature"].to_numpy()] = sums["n"].to_numpy()
    return counts[:, :-1], counts[:, -1]


def _rising(start: float, most: int) -> np.ndarray:
    """log of start (start + 1) ... (start + n - 1) for n = 0 ... most."""
    return np.concatenate([[0.0], np.cumsum(np.log(start + np.arange(most)))])


def ratios(own: np.ndarray, every: np.ndarray, share: float, prior: float, differs: float) -> np.ndarray:
    """Posterior means of a part's rates over the sample's; own, every: documents with the feature in the part and in all."""
    own, every = own.astype(np.int64), every.astype(np.int64)
    most = int(every.max()) if len(every) else 0
    yes, no, all_ = (_rising(prior * x, most) for x in (share, 1 - share, 1.0))
    evidence = yes[own] + no[every - own] - all_[every] - own * np.log(share) - (every - own) * np.log(1 - share)
    odds = np.exp(np.minimum(np.log(differs / (1 - differs)) + evidence, 500.0))
    return (1 + odds * (own + prior * share) / ((every + prior) * share)) / (1 + odds)


@dataclass
class Model:
    """weights[j]: log p_j(feature) / p_target(feature) of each part j beside the target; documents of the sample by part, target first."""

    weights: np.ndarray
    sample: np.ndarray

    def score(self, feature: np.ndarray) -> np.ndarray:
        return self.weights[:, feature].sum(axis=1, dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, prior: float = 4.0, differs: float = 0.01) -> Model:
    """labels: doc_id, quality, toxic (nulls don't count). At most max_labelled labelled ids are used, those with the smallest hashes; an id that is
    labelled more than once is as bad as any row says. The bound is what lets the sample be broadcast to the scan of docs."""
    usable = labels.where("quality is not null and toxic is not null and doc_id is not null")
    usable = usable.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    part = F.when(F.col("quality") == 0, 1).when(F.col("toxic") != 0, 2).otherwise(0)
    sample = materialize(usable.orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(max_labelled).select("id", part.alias("part")), "labelled")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    counts, n = _count(rows.select("text", "part"))
    weights = np.full((len(PARTS), 2 * BUCKETS), 0.0, np.float32)
    held = [j for j in range(len(n)) if counts[j].sum()]
    if 0 in held and len(held) > 1:
        every, total = counts.sum(axis=0), counts.sum()
        rate = (every + 1) / (every + 1).sum()
        log = {}
        for j in held:
            r = ratios(counts[j], every, counts[j].sum() / total, prior, differs)
            log[j] = np.log(r / (r @ rate))
        for j in held[1:]:
            weights[j - 1] = log[j] - log[0]
    else:
        n = np.zeros(len(n))
    return Model(weights, np.where([j in held for j in range(len(n))], n, 0.0))


def log_ratios(text: Column, model: Model) -> Column:
    """log p_j(x) / p_target(x) for each part j beside the target."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(features(t.as_py())) for t in texts], pa.list_(pa.float64()))

    return score(text)


def shares(cells: list[tuple], sample: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Shares of target and parts in all text: expectation maximisation over cells (log ratio of each part, documents), with the sample's labels as known."""
    held = sample > 0
    now = sample / sample.sum()
    if not cells:
        return now
    at = np.array([[0.0, *c[:-1]] for c in cells])[:, held]
    n = np.array([c[-1] for c in cells], float)
    part = now[held]
    for _ in range(rounds):
        p = part * np.exp(at - at.max(axis=1, keepdims=True))
        part = (p / p.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) + sample[held]
        part /= part.sum()
    now[held] = part
    return now


def _kth(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs `key`, by counts of their leading bits; None for k below 1. No row moves."""
    if k < 1:
        return None
    top, left = None, k
    for i in range(PASSES):
        shift = RADIX * (PASSES - 1 - i)
        some = keys if top is None else keys.where(F.shiftright("key", shift + RADIX) == top)
        cells = some.groupBy(F.shiftright("key", shift).alias("lead")).agg(F.count("*").alias("n")).collect()  # 2 ** RADIX at most, but for the first pass
        for lead, n in sorted(map(tuple, cells), reverse=True):
            if n >= left:
                top = lead
                break
            left -= n
    return top


#: What judged() adds: log importance weight, probability of being target, key of the draw, whether it is drawn.
JUDGED = ("weight", "target", "key", "kept")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None, keep: float = 1.02, temperature: float = 1.0, seed: int = 9, **fitting) -> tuple[DataFrame, list[str]]:
    """The columns `keep_columns` of docs with those of JUDGED, written once; and the names that these got, none of which clashes with one of docs."""
    columns = keep_columns or [id_col]
    hash_at, ratio_at, fixed_at, *names = fresh(docs, "hash", "ratios", "fixed", *JUDGED)
    weight_at, target_at, key_at, kept_at = names
    model = fit(docs, labels, id_col, text_col, **fitting)
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias(hash_at)
    ratio = log_ratios(F.col(text_col), model) if model.sample.sum() else F.array(*[F.lit(0.0)] * len(PARTS))
    scored = materialize(docs.select(*columns, hashed, ratio.alias(ratio_at)), "weights")

    cell = [F.bround(F.least(F.greatest(F.col(ratio_at)[j], F.lit(-LIMIT)), F.lit(LIMIT)) / STEP) * STEP for j in range(len(PARTS))]
    share = np.array([1.0] + [0.0] * len(PARTS))
    if model.sample.sum():
        cells = scored.groupBy(*[c.alias(p) for c, p in zip(cell, PARTS, strict=True)]).agg(F.count("*").alias("n")).collect()  # (2 LIMIT / STEP + 1) ** 2 at most
        share = shares(sorted(map(tuple, cells)), model.sample)
    # 1 / weight = share of target + sum of share_j * ratio_j; the exponent stays where doubles hold it
    over = sum((F.lit(float(w)) * F.exp(F.least(F.col(ratio_at)[j], F.lit(600.0))) for j, w in enumerate(share[1:])), F.lit(float(share[0])))
    weight = -F.log(over)
    uniform = (F.shiftrightunsigned(hash_at, 11).cast("double") + 0.5) / float(1 << 53)
    key = weight / temperature - F.log(-F.log(uniform))
    fixed = F.floor(F.least(F.greatest(key, F.lit(-1000.0)), F.lit(1000.0)) * float(1 << FRACTION))
    target = F.lit(float(share[0])) / over
    scored = scored.select(*columns, weight.alias(weight_at), target.alias(target_at), key.alias(key_at), fixed.alias(fixed_at))
    expected = scored.agg(F.sum(F.col(target_at).cast("decimal(19,9)"))).first()[0] or 0
    last = _kth(scored.select(F.col(fixed_at).alias("key")), round(keep * float(expected)))
    return scored.withColumn(kept_at, F.col(fixed_at) >= last if last is not None else F.lit(False)), names


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: id, log_weight (of importance), target_probability, sample_key, kept.

    Empty and null texts have no features, so the weight of raw text as such, 1. Rows that repeat an id are judged each;
    rows that are the same have the same key and are drawn or left together, so that more than k may stay. A null id is
    drawn as any other. Without labels of both target and another kind nothing is known of the difference: all stay. Columns
    that are neither id nor text are not read, whatever their names. An empty table gives an empty result.
    """
    rows, (weight, target, key, kept) = judged(docs, labels, id_col, **options)
    return rows.select(id_col, F.col(weight).alias("log_weight"), F.col(target).alias("target_probability"), F.col(key).alias("sample_key"), F.col(kept).alias("kept"))


def op9_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn, with all their columns, whatever those are called. Nulls, empty texts, repeated rows and empty tables: see classify()."""
    rows, names = judged(docs, table(spark, sf_dir, "labels"), keep_columns=docs.columns)
    return rows.where(F.col(names[-1])).select(*docs.columns)
