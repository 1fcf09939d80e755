"""Language-model scores from Katz backoff.

Tokens are 64-bit hashes of words, and n-grams are hashes chained from them. The corpus is cut into batches of a few
million tokens, written once as arrays. Each batch asks, for its own distinct n-grams of every order, how often training
text has them: the questions are dealt to buckets by n-gram hash, added up there, stored as the count tables (partitioned by
order, a row of arrays for each bucket) and answered. An n-gram however frequent is one number in each batch that has it.

Discounts are Good-Turing for counts up to `discount_upto`, from the counts of counts of each order. The backoff weight
of a history h is what its discounts leave over what the next lower order gives to words not seen after h, so for
every history probabilities add up to one:

    p(w | h) = d(c(h w)) c(h w) / c(h)   if h w was seen in training
             = alpha(h) p(w | h')        if not; alpha is 1 for a history that was not seen

with h' the history less its first word. The lowest order gives what its discounts leave to the one word that stands for
all unknown ones. A history that no discount touches counts once more in its own total, so that it leaves some mass.
The sums over the words of a history are added up like the counts: each distinct n-gram is owned by one of its batches.
Probabilities of a text's tokens are then found by that recursion, on arrays, and added up for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .words import texts_of, words_of

_word = xxhash.xxh64_intdigest
#: The end of a text, and its beginning as the history of 1, 2, ... words; no words, as those have another seed.
END = np.uint64(_word(b"end", 7))
BEGIN = [np.uint64(0)] + [np.uint64(_word(b"begin %d" % m, 7)) for m in range(1, 10)]


def _chain(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = history * np.uint64(0x9E3779B97F4A7C15) ^ word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def batches_of(docs: DataFrame, id_col: str, text_col: str, train: Column, batch_tokens: int) -> DataFrame:
    """Documents as arrays: batch, n_tokens, ids, held (bytes), lengths (int32, without the beginning), vocabulary (uint64), codes (int32)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).cast("binary").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, made = TaskContext.get().partitionId() << 32, 0
        ids, held, hashes, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            vocabulary, codes, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            by_use = np.argsort(-often, kind="stable")  # small codes for frequent words: they compress
            at = np.empty(len(by_use), np.int32)
            at[by_use] = np.arange(len(by_use), dtype=np.int32)
            blobs = [np.array(held, np.uint8), np.array([len(h) for h in hashes], np.int32), vocabulary[by_use], at[codes]]
            columns = [pa.array([place + made], pa.int64()), pa.array([size], pa.int64()), pa.array([pa.array(ids, id_pa).to_pylist()], pa.list_(id_pa))]
            return pa.RecordBatch.from_arrays(columns + [pa.array([b.tobytes()], pa.binary()) for b in blobs], ["batch", "n_tokens", "ids", "held", "lengths", "vocabulary", "codes"])

        for b in batches:
            id_pa = b["id"].type
            for one, is_train, text in zip(b["id"].to_pylist(), b["train"].to_pylist(), texts_of(b["text"]), strict=True):
                words = words_of(text)
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = np.fromiter(map(_word, words), np.uint64, len(words))
                h[-1] = END
                ids.append(one)
                held.append(not is_train)
                hashes.append(h)
                size += len(h)
                if size >= batch_tokens:
                    yield flush()
                    made += 1
                    ids, held, hashes, size = [], [], [], 0
        if ids:
            yield flush()

    return rows.mapInArrow(write, f"batch long, n_tokens long, ids array<{id_type}>, held binary, lengths binary, vocabulary binary, codes binary")


class Grams:
    """The n-grams of a batch. Slots are the tokens with one beginning before each document's; key[m] holds the m-grams that end at each slot."""

    def __init__(self, row: dict, order: int):
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        held = np.frombuffer(row["held"], np.uint8).astype(bool)
        words = np.frombuffer(row["vocabulary"], np.uint64)[np.frombuffer(row["codes"], np.int32)]
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        n = int((lengths + 1).sum())
        self.is_begin = np.zeros(n, bool)
        self.is_begin[self.begin] = True
        one = np.empty(n, np.uint64)
        one[~self.is_begin] = words
        one[self.begin] = BEGIN[1]
        self.train = np.repeat(~held, lengths + 1)
        self.keys, self.at = [None], [None]
        key = one
        for m in range(1, order + 1):
            if m > 1:
                key = _chain(np.concatenate([key[:1], key[:-1]]), one)
                key[self.begin] = BEGIN[m]
            distinct, at = np.unique(key, return_inverse=True)
            self.keys.append(distinct)
            self.at.append(at.astype(np.int32))

    def counts(self, m: int) -> np.ndarray:
        return np.bincount(self.at[m][self.train], minlength=len(self.keys[m]))


def _edges(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket of equal width begins in sorted keys."""
    return np.searchsorted(keys, np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)).tolist() + [len(keys)]


def _small(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def _sized(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(blob) // n] if n else np.uint8).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the gaps between them, the first byte of each, then the second of each and so on: the high bytes are zeros and compress."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64)


_ASKED = "m int, bucket int, batch long, keys binary, counts binary"
_ANSWERED = "bucket int, batch long, keys binary, counts binary, own binary, stats array<long>, kind string, m int"


def _ask_counts(order: int, buckets: int):
    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for row in b.to_pylist():
                grams = Grams(row, order)
                for m in range(1, order + 1):
                    counts, edges = grams.counts(m), _edges(grams.keys[m], buckets)
                    some = [i for i in range(buckets) if edges[i] < edges[i + 1]]
                    keys = [packed(grams.keys[m][edges[i] : edges[i + 1]]) for i in some]
                    n = [_small(counts[edges[i] : edges[i + 1]]) for i in some]
                    columns = [pa.array([m] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["m", "bucket", "batch", "keys", "counts"])

    return ask


def _add_counts(discount_upto: int):
    """For one order and bucket: a row of the count table, and for each batch the total counts of its keys and which of them it owns."""

    def add(asked: pa.Table) -> pa.Table:
        m, bucket = asked["m"][0].as_py(), asked["bucket"][0].as_py()
        asked = asked.sort_by("batch")
        batch = asked["batch"].to_pylist()
        keys = [unpacked(k.as_py()) for k in asked["keys"]]
        counts = [_sized(c.as_py(), len(k)) for c, k in zip(asked["counts"], keys, strict=True)]
        every, local = np.concatenate(keys), np.concatenate(counts)
        distinct, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, local, len(distinct)).astype(np.int64)
        has = np.flatnonzero(local > 0)[::-1]
        owner = np.full(len(distinct), -1, np.int64)
        owner[at[has]] = has  # the first of those that have it, as the last to be written
        own = np.zeros(len(every), bool)
        own[owner[owner >= 0]] = True
        seen = (total > 0) & (distinct != BEGIN[m])
        low = np.bincount(np.minimum(total[seen], discount_upto + 2), minlength=discount_upto + 3)
        stats = [int(total[seen].sum()), int(seen.sum()), *map(int, low[1 : discount_upto + 2])]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(bucket, None, packed(distinct[total > 0]), _small(total[total > 0]), None, stats, "table", m)]
        for b, t, o in zip(batch, np.split(total[at], cuts), np.split(own, cuts), strict=True):
            rows.append((bucket, b, None, _small(t), np.packbits(o).tobytes(), None, "answer", m))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string(), pa.int32()]
        names = ["bucket", "batch", "keys", "counts", "own", "stats", "kind", "m"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return add


def discounts(stats: list[int], upto: int) -> np.ndarray:
    """Good-Turing discounts by count, 0 to upto; 1 above. stats: tokens, types, and how many types have counts of 1, 2, ..., upto + 1.

    Katz's ratio is used where it lies between 0 and 1; where counts of counts are too sparse for that, (r - D) / r with
    D = n1 / (n1 + 2 n2), which is absolute discounting.
    """
    n = [0, *stats[2:]]
    d = np.ones(upto + 1)
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    common = (upto + 1) * n[upto + 1] / n[1] if n[1] else 1.0
    for r in range(1, upto + 1):
        katz = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = katz if 0 < katz < 1 else (r - min(flat, 0.9)) / r
    return d


class Model:
    """What all tasks know: discounts of each order, and the lowest order's total and share for the unknown word."""

    def __init__(self, order: int, upto: int, stats: dict[int, list[int]]):
        none = [0] * (upto + 3)
        self.order, self.upto = order, upto
        self.d = [None] + [discounts(stats.get(m, none), upto) for m in range(1, order + 1)]
        self.tokens, self.types = stats.get(1, none)[:2]
        n = stats.get(1, none)[2:]
        left = sum((1 - self.d[1][r]) * r * n[r - 1] for r in range(1, upto + 1))
        self.total = self.tokens if left > 0 else self.tokens + 1
        self.unknown = (left if left > 0 else 1.0) / self.total


def _discounted(model: Model, m: int, c: np.ndarray) -> np.ndarray:
    factor = np.append(model.d[m], 1.0)[np.minimum(c, model.upto + 1)]
    return factor * c


class Batch:
    """A batch with the answers to it: total counts and ownership by order, and of each history the share it backs off with."""

    def __init__(self, row: dict, answers: pa.Table, model: Model):
        self.model, self.grams = model, Grams(row, model.order)
        self.count, self.own, self.back = [None] * (model.order + 1), [None] * (model.order + 1), [None] * (model.order + 1)
        for m in range(1, model.order + 1):
            self.count[m], self.own[m] = [], []
        for r in sorted(answers.to_pylist(), key=lambda r: (r["m"], r["bucket"])):
            if r["kind"] == "answer":
                n = self._asked(r["m"], r["bucket"], r["n_buckets"])
                self.count[r["m"]].append(_sized(r["counts"], n))
                self.own[r["m"]].append(np.unpackbits(np.frombuffer(r["own"], np.uint8), count=n).astype(bool))
            else:
                self.back[r["m"]] = (self.back[r["m"]] or []) + [np.frombuffer(r["counts"], np.float64)]
        for m in range(1, model.order + 1):
            self.count[m], self.own[m] = np.concatenate(self.count[m]), np.concatenate(self.own[m])
            if self.back[m] is not None:
                self.back[m] = np.concatenate(self.back[m])

    def _asked(self, m: int, bucket: int, buckets: int) -> int:
        keys = self.grams.keys[m]
        lo = np.searchsorted(keys, np.uint64((bucket << 64) // buckets))
        hi = len(keys) if bucket + 1 == buckets else np.searchsorted(keys, np.uint64((bucket + 1 << 64) // buckets))
        return int(hi - lo)

    def history(self, m: int) -> np.ndarray:
        """For each slot, the place among the (m-1)-grams of the one that ends before it; of no meaning at beginnings."""
        at = self.grams.at[m - 1]
        return np.concatenate([at[:1], at[:-1]])

    def lowest(self) -> np.ndarray:
        c = self.count[1]
        p = np.where(c > 0, _discounted(self.model, 1, c) / self.model.total, self.model.unknown)
        return p[self.grams.at[1]]

    def seen(self, m: int) -> np.ndarray:
        """p(w | h) by order m at each slot whose m-gram was seen; 0 elsewhere. Needs the histories' answers, as a total may count once more."""
        c = self.count[m][self.grams.at[m]]
        history = self.history(m)
        total = self.count[m - 1][history] + (self.back[m][history] < 0)
        return np.where(c > 0, _discounted(self.model, m, c) / np.maximum(total, 1), 0.0)

    def sums(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """For each history, over the m-grams of it that this batch owns: discounted counts, and what order m - 1 gives to their last words."""
        grams, n = self.grams, len(self.grams.keys[m - 1])
        first = np.full(len(grams.keys[m]), -1, np.int64)
        slots = np.flatnonzero(~grams.is_begin)
        first[grams.at[m][slots[::-1]]] = slots[::-1]
        slots = first[self.own[m] & (first >= 0)]
        history = self.history(m)[slots]
        lower = self.lowest()[slots] if m == 2 else self.seen(m - 1)[slots]
        return np.bincount(history, _discounted(self.model, m, self.count[m][grams.at[m][slots]]), n), np.bincount(history, lower, n)

    def scores(self) -> tuple[np.ndarray, ...]:
        """By document: tokens, known tokens, base score, score."""
        grams, model = self.grams, self.model
        p = self.lowest()
        for m in range(2, model.order + 1):
            history = self.history(m)
            back = np.where(self.count[m - 1][history] > 0, np.abs(self.back[m][history]), 1.0)
            seen = self.seen(m)
            p = np.where(seen > 0, seen, back * p)
        c = self.count[1][grams.at[1]]
        base = np.log10((c + 1.0) / (model.tokens + model.types + 1.0))
        token = ~grams.is_begin
        add = lambda x: np.add.reduceat(np.where(token, x, 0), grams.begin)
        return add(np.ones(len(p), np.int64)), add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def _ask_sums(level: int, buckets: int, model: Model):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left.to_pylist()[0], right, model)
        mass, lower = batch.sums(level)
        keys, count, rows = batch.grams.keys[level - 1], batch.count[level - 1], []
        edges = _edges(keys, buckets)
        for i in range(buckets):
            a, b = edges[i], edges[i + 1]
            if a < b:
                rows.append((level, i, left["batch"][0].as_py(), packed(keys[a:b]), _small(count[a:b]), np.concatenate([mass[a:b], lower[a:b]]).tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["m", "bucket", "batch", "keys", "counts", "own"])

    return ask


def _add_sums():
    """For one bucket of histories: what each backs off with, negative where its total counts once more."""

    def add(asked: pa.Table) -> pa.Table:
        m, bucket = asked["m"][0].as_py(), asked["bucket"][0].as_py()
        asked = asked.sort_by("batch")
        keys = [unpacked(k.as_py()) for k in asked["keys"]]
        count = np.concatenate([_sized(c.as_py(), len(k)) for c, k in zip(asked["counts"], keys, strict=True)])
        sums = np.concatenate([np.frombuffer(s.as_py(), np.float64).reshape(2, -1) for s in asked["own"]], axis=1)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        mass, lower = (np.bincount(at, s, len(distinct)) for s in sums)
        total = np.zeros(len(distinct))
        total[at] = count
        bare = total - mass <= 1e-9 * total
        total = total + bare
        left = np.where(mass > 0, (total - mass) / np.maximum(total, 1), 1.0)
        back = left / np.maximum(np.where(mass > 0, 1 - lower, 1.0), 1e-12)
        back = np.where(bare, -back, back)[at]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(bucket, b, None, x.tobytes(), None, None, "back", m) for b, x in zip(asked["batch"].to_pylist(), np.split(back, cuts), strict=True)]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string(), pa.int32()]
        names = ["bucket", "batch", "keys", "counts", "own", "stats", "kind", "m"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return add


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, discount_upto: int = 5,
                batch_tokens: int = 1 << 21, bucket_tokens: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """Scores of all texts by a model of those rows for which train holds, and the model's count tables.

    Scores: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability), one row per row of docs.
    Counts, partitioned by order: m, bucket, keys (see packed) and counts (unsigned) as bytes, one row a bucket.
    Null texts are empty: one end token. A null train counts as true. Rows that repeat are scored and, if they train,
    counted each. Without training text every token is unknown and certain: scores of 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    state = materialize(batches_of(docs, id_col, text_col, train, batch_tokens), "token-batches", compression="zstd")
    tokens = state.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(8, -(-tokens // bucket_tokens))

    asked = state.mapInArrow(_ask_counts(order, buckets), _ASKED)
    counted = materialize(asked.groupBy("m", "bucket").applyInArrow(_add_counts(discount_upto), _ANSWERED), "ngram-counts", ("kind", "m"), "zstd")
    tables = counted.where("kind = 'table'")
    per = tables.select("m", F.posexplode("stats").alias("i", "n")).groupBy("m", "i").agg(F.sum("n").alias("n")).collect()
    stats: dict[int, list[int]] = {}
    for r in sorted(per, key=lambda r: (r.m, r.i)):
        stats.setdefault(r.m, []).append(r.n)
    model = Model(order, discount_upto, stats)

    answers = counted.where("kind = 'answer'").select("batch", "kind", "m", "bucket", F.lit(buckets).alias("n_buckets"), "counts", "own")
    backs = []
    for level in range(2, order + 1):
        asked = state.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_ask_sums(level, buckets, model), _ASKED + ", own binary")
        back = materialize(asked.groupBy("m", "bucket").applyInArrow(_add_sums(), _ANSWERED), "backoff", compression="zstd")
        backs.append(back)
        answers = answers.unionByName(back.select("batch", "kind", "m", "bucket", F.lit(buckets).alias("n_buckets"), "counts", "own"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        batch = Batch(row, right, model)
        n, known, base, p = batch.scores()
        held = np.frombuffer(row["held"], np.uint8).astype(bool)
        ids = left["ids"].combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(p)], _NAMES)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = state.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)
    return scored.withColumnRenamed("id", id_col), tables.select("m", "bucket", "keys", "counts")


_NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def op1_katz(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)[0]
