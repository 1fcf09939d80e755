"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased (A-Z) and ASCII punctuation parts words. An item of n words is held against the windows of n words
of each document (a shorter document is one window). Windows and items have SimHash fingerprints of their five-word
shingles (of all words, for items of fewer). Fingerprints are cut into four blocks of 16 bits: of two that differ in at
most `radius` bits one block differs in at most radius // 4, so looking up each block's neighbours finds every item
within the radius. Of those, an item is in a document if the shingles, weighted by how often they occur, overlap in
`similarity` of their union or more. Windows that share no shingle with an item of their size have similarity 0 and get
no fingerprint: only the surroundings of shingles that the benchmark has are looked at.

Documents are read once for each `block_items` items of the benchmark, which are what a task holds; a pass needs no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, table

SHINGLE = 5
#: ASCII punctuation parts words, A-Z are lower-cased.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", b"abcdefghijklmnopqrstuvwxyz" + b" " * 32)
_h = xxhash.xxh64_intdigest
_GATE_BITS = 22
#: Windows that are fingerprinted at once; what a text takes beside itself follows from this and the longest item.
CHUNK = 4096


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_h, words), np.uint64, len(words))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words from the hashes of the words."""
    n = max(len(hashes) - size + 1, 0)
    found = hashes[:n].copy()
    for k in range(1, size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
    found ^= found >> np.uint64(32)
    return found * np.uint64(0xC2B2AE3D27D4EB4F)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared weight over the weight of the union."""
    shared = (a & b).total()
    union = a.total() + b.total() - shared
    return shared / union if union else 0.0


def _starts(hits: np.ndarray, n: int, size: int, last: int) -> Iterator[np.ndarray]:
    """First words of the windows of n words that hold a hit, rising, CHUNK at most at a time and from one cluster of hits."""
    low, high = np.clip(hits - n + size, 0, last), np.minimum(hits, last) + 1
    ends = np.flatnonzero(np.append(low[1:] > high[:-1], True))  # both rise with the hits
    for a, b in zip(low[np.append(0, ends[:-1] + 1)].tolist(), high[ends].tolist(), strict=True):
        for i in range(a, b, CHUNK):
            yield np.arange(i, min(i + CHUNK, b))


class Items:
    """A block of benchmark items: shingles by size of window, and fingerprints by blocks of 16 bits."""

    def __init__(self, rows: list[tuple], radius: int):
        self.radius = radius
        near = [0] + [sum(1 << b for b in c) for k in range(1, radius // 4 + 1) for c in combinations(range(16), k)]
        self.near = np.array(near, np.uint64)
        self.ids, self.sizes, self.counts, prints = [], [], [], []
        owners: dict[tuple[int, int], set[int]] = {}
        for item_id, text in rows:
            words = word_hashes(plain_words(text.encode() if text else None))
            if not len(words):
                continue
            size = min(SHINGLE, len(words))
            g = grams(words, size)
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.counts.append(Counter(g.tolist()))
            prints.append(_pack(2 * _bits(g).sum(axis=0, dtype=np.int64)[None, :] > len(g))[0])
            for x in g.tolist():
                owners.setdefault((size, x), set()).add(len(words))
        self.prints = np.array(prints, np.uint64)
        self.gates = {}
        for size in {s for s, _ in owners}:
            keys = np.array(sorted(x for s, x in owners if s == size), np.uint64)
            gate = np.zeros(1 << _GATE_BITS, bool)
            gate[keys >> np.uint64(64 - _GATE_BITS)] = True
            self.gates[size] = gate, keys, [sorted(owners[size, x]) for x in keys.tolist()]
        self.at: dict[int, list[dict[int, list[int]]]] = {}
        for i, (n, f) in enumerate(zip(self.sizes, prints, strict=True)):
            tables = self.at.setdefault(n, [{}, {}, {}, {}])
            for b in range(4):
                tables[b].setdefault(int(f) >> 16 * b & 0xFFFF, []).append(i)
        self.blocks = {n: [(np.array(sorted(t), np.uint64), t) for t in tables] for n, tables in self.at.items()}

    def within(self, n: int, prints: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) for all items of n words whose fingerprints are within the radius: through each block's neighbours."""
        found = set()
        for b, (keys, held) in enumerate(self.blocks[n]):
            value = prints >> np.uint64(16 * b) & np.uint64(0xFFFF)
            if len(keys) <= len(self.near):  # the same pairs, found from the shorter list
                w, k = np.nonzero(np.bitwise_count(value[:, None] ^ keys[None, :]) <= self.radius // 4)
                pairs = zip(w.tolist(), keys[k].tolist(), strict=True)
            else:
                want = value[:, None] ^ self.near[None, :]
                w, k = np.nonzero(np.isin(want, keys))
                pairs = zip(w.tolist(), want[w, k].tolist(), strict=True)
            for w, key in pairs:
                for i in held[key]:
                    if (int(prints[w]) ^ int(self.prints[i])).bit_count() <= self.radius:
                        found.add((w, i))
        return found

    def leaks(self, text: bytes | None, similarity: float) -> list[tuple]:
        """(item id, similarity, first word, words, differing bits) of the best window for each item that the text has."""
        words = word_hashes(plain_words(text))
        best: dict[int, tuple] = {}
        for size, (gate, keys, sizes) in self.gates.items():
            g = grams(words, size)
            hits = np.flatnonzero(gate[g >> np.uint64(64 - _GATE_BITS)])
            if not len(hits):
                continue
            at = np.searchsorted(keys, g[hits])
            sure = keys[np.minimum(at, len(keys) - 1)] == g[hits]
            hits, at = hits[sure], at[sure]
            places: dict[int, list[int]] = {}
            for i, a in zip(hits.tolist(), at.tolist(), strict=True):
                for n in sizes[a]:
                    places.setdefault(n, []).append(i)
            for n, some in places.items():
                m = min(n - size + 1, len(g))
                for first in _starts(np.array(some), n, size, max(len(words) - n, 0)):
                    low = int(first[0])
                    sums = np.zeros((int(first[-1]) - low + m + 1, 64), np.int32)
                    np.cumsum(_bits(g[low : low + len(sums) - 1]), axis=0, out=sums[1:], dtype=np.int32)
                    prints = _pack(2 * (sums[first - low + m] - sums[first - low]) > m)
                    for w, i in self.within(n, prints):
                        s = int(first[w])
                        alike = weighted_similarity(Counter(g[s : s + m].tolist()), self.counts[i])
                        if alike >= similarity:
                            bits = (int(prints[w]) ^ int(self.prints[i])).bit_count()
                            best[i] = min(best.get(i, (0.0,)), (-alike, s, min(n, len(words)), bits))
        return [(self.ids[i], -a, s, n, bits) for i, (a, s, n, bits) in best.items()]


def _search(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, similarity: float, radius: int, block_items: int) -> DataFrame:
    """doc, text_hash, item, similarity, first_word, n_words, differing_bits: for each row of docs and item of a block of items the best window."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    item_type = dict(benchmark.dtypes)[item_col]
    schema = f"doc {id_type}, text_hash long, item {item_type}, similarity double, first_word long, n_words long, differing_bits int"
    items = materialize(benchmark.select(item_col, "text").where("text is not null"), "benchmark")
    n_blocks = max(1, -(-items.count() // block_items))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    found = None
    for b in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64(item_col, "text"), F.lit(n_blocks)) == b).collect()  # block_items or about as many
        held = spark.sparkContext.broadcast(Items([tuple(r) for r in own], radius))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = zip(batch["doc"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"], strict=True)
                out = [(doc, mark, *leak) for doc, mark, text in keys for leak in held.value.leaks(text.as_py(), similarity)]
                columns = list(zip(*out, strict=True))
                kinds = [batch["doc"].type, pa.int64(), None, pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                names = ["doc", "text_hash", "item", "similarity", "first_word", "n_words", "differing_bits"]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = 0.8,
               radius: int = 15, block_items: int = 20_000) -> DataFrame:
    """One row for each document and item that it holds: id, item id, similarity, first_word, n_words, differing_bits (of the best window).

    Null and empty texts hold nothing, and null, empty and word-free items are in nothing. Rows and items that repeat
    an id give the better answer once; a null id is an id like any other. Other columns are not read, whatever their names. Either
    table empty: an empty result. Texts are read whole, whatever their length.
    """
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("f"), "n_words", "differing_bits"))
    found = _search(docs, benchmark, id_col, text_col, item_col, similarity, radius, block_items).groupBy("doc", "item").agg(best.alias("b"))
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.similarity", (-F.col("b.f")).alias("first_word"), "b.n_words", "b.differing_bits")


def op4_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever those are called.

    A row goes by its id and its own text, so rows without an id, and those that repeat an id with another text, are judged
    each. Null and empty texts hold nothing and stay, rows that repeat stay or go together. An empty table, or an empty benchmark: all stay.
    """
    of_id, of_hash, hashed = fresh(docs, "of_id", "of_hash", "text_hash")
    leaky = _search(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", 0.8, 15, 20_000)
    leaky = materialize(leaky.select(F.col("doc").alias(of_id), F.col("text_hash").alias(of_hash)).distinct(), "leaky")
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(hashed) == F.col(of_hash))
    return docs.withColumn(hashed, F.xxhash64("text")).join(leaky, same, "left_anti").select(*docs.columns)
