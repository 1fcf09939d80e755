"""Substring dedup: passages that several documents share stay in the first of them only.

A window is a number of consecutive words of one document. It recurs if a document of smaller id has the same words in a
row. Every word that a recurring window covers goes.

1. Anchors. Of the runs of half a window's words in a window, the one with the least hash is its anchor; equal windows have
   equal anchors, and neighbours mostly share theirs, so there are about a quarter as many anchors as words. Anchors that
   two documents have are found by one aggregate. A block is named by the place where a recurring anchor stands first.
2. Segments. Windows with a recurring anchor, in runs of one block, are cut from their documents. Nothing else can recur.
3. Phrases. Windows of the segments that two documents have are confirmed by an aggregate of their hashes within a block;
   the first document gives the words, as passages.
4. Automata. The phrases of a block are one Aho-Corasick automaton over word numbers, or several of bounded size; the
   segments of a block, in shares of bounded size, stream through each of its automata. Each occurrence of a phrase in a
   document of a larger id than that of its first is a recurring window, word by word.
5. Words that are covered are dropped from the whole texts.

So a document passes only through the automata of blocks that it has an anchor of. A passage of very many documents is a
block with many shares, each with its own copy of the automaton. Aggregates are partial before they shuffle, joins are plain
equi-joins, and what they read is written first, so adaptive execution can split a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, table
from .words import texts_of

#: Words of a first document that name one block; windows of a passage; phrases of an automaton; words of a share of a block's segments.
BLOCK_WORDS, PASSAGE, AUTOMATON, SHARE = 2048, 1024, 50_000, 1 << 15
#: Bytes that are hashed at a time, so that a long text needs no arrays of its length in bytes; bytes of texts that are handled together.
CHUNK, TOGETHER = 1 << 20, 1 << 22
#: The id of rows without one: after all others.
NO_ID = (1 << 63) - 1
FACTOR = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd factor, and of its inverse, modulo 2 ** 64."""
    letters = _mixed(np.arange(1, 257, dtype=np.uint64) * _A)
    both = (np.full(CHUNK + 1, f, np.uint64) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
    up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(x[:-1], dtype=np.uint64)]) for x in both)
    return letters, up, down


def words_at(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in a text, and a 64-bit hash of each."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters, up, down = _powers()
    found = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), CHUNK):  # a word that goes on in the next chunk adds up from both
        part = data[a : a + CHUNK]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[part] * up[: len(part)], dtype=np.uint64)])
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, a + len(part), side="left")
        s, e = np.maximum(starts[i:j] - a, 0), np.minimum(ends[i:j] - a, len(part))
        whole = (sums[e] - sums[s]) * down[s]
        if j > i and starts[i] < a:
            whole[:1] *= np.uint64(pow(FACTOR, a - int(starts[i]), 1 << 64))
        found[i:j] += whole
    return starts, ends, _mixed(found ^ (ends - starts).astype(np.uint64) * _A)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for k in range(size):
        found = found * _A + hashes[k : k + n]
    return _mixed(found)


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window the hash of its anchor: the least of its runs of half a window."""
    size = (window + 1) // 2
    found = runs(hashes, size)
    n = max(len(hashes) - window + 1, 0)
    least = found[:n].copy()
    for k in range(1, window - size + 1):
        np.minimum(least, found[k : k + n], out=least)
    return least


class Piece:
    """Some texts on end, so that few calls of numpy hash them all: words of all texts, and which windows lie in one text."""

    def __init__(self, texts: list[bytes], window: int):
        self.text = b"\n".join(texts)
        self.starts, self.ends, self.hashes = words_at(self.text)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        first = np.searchsorted(self.starts, begins)  # word at which each text begins
        self.row = np.repeat(np.arange(len(texts)), np.diff([*first, len(self.starts)]))  # of each word
        n = max(len(self.row) - window + 1, 0)
        self.whole = self.row[:n] == self.row[window - 1 :]
        self.place = np.arange(n) - first[self.row[:n]]  # of a window in its text

    def cut(self, a: int, b: int) -> bytes:
        """The text from word a up to word b."""
        return self.text[self.starts[a] : self.ends[b - 1]]


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[Piece, pa.RecordBatch]]:
    """Rows of batches, as many together as have TOGETHER bytes of text."""
    for b in batches:
        texts, size, begin = [], 0, 0
        for i, text in enumerate(texts_of(b["text"])):
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= TOGETHER:
                yield Piece(texts, window), b.slice(begin, i + 1 - begin)
                texts, size, begin = [], 0, i + 1
        if texts:
            yield Piece(texts, window), b.slice(begin)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns has another value than before; and the length."""
    n = len(columns[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """rows: id, text_hash, text. anchor, id, text_hash, place (of a window that has it), once for each run of windows of one anchor."""

    def find(batches):
        for piece, b in _pieces(batches, window):
            least = anchors(piece.hashes, window)
            at = np.flatnonzero(piece.whole)
            at = at[_changes(least[at], piece.row[at])[:-1]]
            row = piece.row[at]
            yield _batch(["anchor", "id", "text_hash", "place"], least[at].view(np.int64), _numbers(b, "id")[row], _numbers(b, "text_hash")[row], piece.place[at])

    return rows.mapInArrow(find, "anchor long, id long, text_hash long, place long")


def _found(sought: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: sorted. Where each of sought would be in keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, sought), max(len(keys) - 1, 0))
    return at, keys[at] == sought if len(keys) else np.zeros(len(sought), bool)


def segment_rows(rows: DataFrame, window: int) -> DataFrame:
    """rows: id, text_hash, text, known (array of anchor, block). block, id, text_hash, start (words before), text of each segment.

    What a text of a piece knows holds for the others: a block is a matter of the anchor alone.
    """

    def find(batches):
        for piece, b in _pieces(batches, window):
            known = b["known"].flatten()
            keys, first = np.unique(known.field(0).to_numpy(), return_index=True)
            of = known.field(1).to_numpy()[first]
            at, has = _found(anchors(piece.hashes, window).view(np.int64), keys)
            has &= piece.whole
            block = np.where(has, of[at], 0) if len(of) else np.zeros(len(at), np.int64)
            edges = _changes(block, has, piece.row[: len(has)])
            begin = edges[:-1][has[edges[:-1]]]
            end = edges[1:][has[edges[:-1]]]
            row = piece.row[begin]
            texts = pa.array([piece.cut(p, q + window - 1) for p, q in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            yield _batch(["block", "id", "text_hash", "start", "text"], block[begin], _numbers(b, "id")[row], _numbers(b, "text_hash")[row], piece.place[begin], texts)

    return rows.mapInArrow(find, "block long, id long, text_hash long, start long, text binary")


def window_rows(segments: DataFrame, window: int) -> DataFrame:
    """block, phrase (the hash of a window), id, for each window of a segment."""

    def find(batches):
        for piece, b in _pieces(batches, window):
            row = piece.row[: len(piece.whole)][piece.whole]
            yield _batch(["block", "phrase", "id"], _numbers(b, "block")[row], runs(piece.hashes, window)[piece.whole].view(np.int64), _numbers(b, "id")[row])

    return segments.select("block", "id", "text").mapInArrow(find, "block long, phrase long, id long")


def passage_rows(segments: DataFrame, window: int) -> DataFrame:
    """segments: block, id, start, text, phrases (those that are first in this document). block, id, start, n (windows), text of each passage."""

    def find(batches):
        for piece, b in _pieces(batches, window):
            ids = _numbers(b, "id")
            phrases = b["phrases"]
            keys, at = np.unique(phrases.flatten().to_numpy(), return_index=True)
            first = np.repeat(ids, phrases.value_lengths().to_numpy())[at]  # a phrase has one document that is its first
            row = piece.row[: len(piece.whole)]
            at, has = _found(runs(piece.hashes, window).view(np.int64), keys)
            mine = has & piece.whole
            mine[mine] = first[at[mine]] == ids[row[mine]]
            edges = _changes(mine, row)
            out = [(p, z) for x, q in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if mine[x] for p in range(x, q, PASSAGE) for z in [min(p + PASSAGE, q)]]
            begin, end = np.array(out, np.int64).reshape(-1, 2).T
            start = _numbers(b, "start")[row[begin]] + piece.place[begin]
            texts = pa.array([piece.cut(p, z + window - 1) for p, z in out], pa.binary())
            yield _batch(["block", "id", "start", "n", "text"], _numbers(b, "block")[row[begin]], ids[row[begin]], start, end - begin, texts)

    return segments.mapInArrow(find, "block long, id long, start long, n long, text binary")


class Phrases:
    """An Aho-Corasick automaton over the windows of passages, as sequences of word numbers; each with the id of its first document."""

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.number = window, {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)

    def add(self, passage: bytes, first: int) -> None:
        number = self.number
        words = [number.setdefault(w, len(number) + 1) for w in passage.split()]
        for i in range(len(words) - self.window + 1):
            self.automaton.add_word(tuple(words[i : i + self.window]), first)

    def ready(self) -> Phrases:
        self.automaton.make_automaton()
        return self

    def later(self, text: bytes, doc: int) -> list[int]:
        """Where windows start that occur in a document of a smaller id than doc."""
        if not len(self.automaton):
            return []
        get, back = self.number.get, self.window - 1
        return [end - back for end, first in self.automaton.iter(tuple([get(w, 0) for w in text.split()])) if first < doc]


def occurrences(rows: DataFrame, window: int) -> DataFrame:
    """rows, sorted: block, part, share, kind (0: passage, 1: segment), id, text_hash, start, text. id, text_hash, spans (from, to, from, to, ... in words of the text)."""

    def stream(batches):
        at, phrases, done = None, None, False
        for b in batches:
            ids, hashes, spans = [], [], []
            columns = [b[c].to_pylist() for c in ("block", "part", "share", "kind", "id", "text_hash", "start")]
            for text, block, part, share, kind, i, h, start in zip(texts_of(b["text"]), *columns, strict=True):
                if at != (block, part, share):
                    at, phrases, done = (block, part, share), Phrases(window), False
                if kind == 0:
                    phrases.add(text, i)
                    continue
                if not done:
                    phrases, done = phrases.ready(), True
                if found := phrases.later(text, i):
                    own, last = [], -1
                    for k in found:
                        if k > last:
                            own += [start + k, start + k + window]
                        else:
                            own[-1] = start + k + window
                        last = k + window
                    ids.append(i)
                    hashes.append(h)
                    spans.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["id", "text_hash", "spans"])

    return rows.mapInArrow(stream, "id long, text_hash long, spans array<long>")


def without(text: bytes, spans: list[int] | None) -> tuple[bytes, int, int]:
    """What stays of a text, one space between words; how many words it has, and how many go."""
    words = text.split()
    if not spans:
        return b" ".join(words), len(words), 0
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.array(spans[::2]), 1)
    np.add.at(change, np.array(spans[1::2]), -1)
    gone = np.cumsum(change[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), len(words), int(gone.sum())


def _kept(text: Column, spans: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<text: string, n_words: long, n_removed: long>")
    def keep(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = [without(t or b"", s.as_py()) for t, s in zip(texts_of(texts), found, strict=True)]
        kept, n, gone = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_words", "n_removed"])

    return keep(text, spans)


def recurring(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """id, text_hash, spans: words of each text that recurring windows cover. id: as a long, NO_ID for null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = anchor_rows(rows, window)
    block = F.xxhash64("first", F.expr(f"place div {BLOCK_WORDS}")).alias("block")
    shared = found.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("place", "id").alias("place")).where("first < last")
    shared = materialize(shared.select("anchor", block), "shared-anchors")
    known = found.select("anchor", "text_hash").join(shared, "anchor").groupBy("text_hash").agg(F.collect_set(F.struct("anchor", "block")).alias("known"))
    known = materialize(known, "known-anchors")
    discard(shared)
    segments = materialize(segment_rows(rows.join(known, "text_hash").select("id", "text_hash", "text", "known"), window), "segments", compression="zstd")
    discard(known)

    phrases = window_rows(segments, window).groupBy("block", "phrase").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    phrases = materialize(phrases.groupBy("block", F.col("first").alias("id")).agg(F.collect_list("phrase").alias("phrases")), "phrases")
    of_first = segments.select("block", "id", "start", "text").join(phrases, ["block", "id"])
    passages = materialize(passage_rows(of_first.select("block", "id", "start", "text", "phrases"), window), "passages", compression="zstd")
    discard(phrases)

    words = F.octet_length("text") / 6  # for the size of a share; no need to be exact
    size = segments.groupBy("block").agg(F.ceil(F.sum(words) / SHARE).cast("int").alias("shares"))
    cells = passages.groupBy("block").agg(F.ceil(F.sum("n") / AUTOMATON).cast("int").alias("parts"), F.min("id").alias("least")).join(size, "block")
    cells = materialize(cells, "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda n: F.pmod(F.xxhash64("id", "start"), F.col(n)).cast("int")
    columns = ["block", "part", "share", "kind", "id", "text_hash", "start", "text"]
    patterns = passages.join(cells, "block").withColumn("part", pick("parts")).withColumn("share", every("shares"))
    patterns = patterns.withColumn("kind", F.lit(0)).withColumn("text_hash", F.lit(0).cast("long"))
    streams = segments.join(cells, "block").where(F.col("id") > F.col("least")).withColumn("share", pick("shares")).withColumn("part", every("parts")).withColumn("kind", F.lit(1))
    both = patterns.select(*columns).unionByName(streams.select(*columns)).repartition("block", "part", "share")
    spans = occurrences(both.sortWithinPartitions("block", "part", "share", "kind"), window)
    spans = materialize(spans.groupBy("id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    discard(segments, passages, cells)
    return spans


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """docs with text_col replaced by the words that stay, one space between them, and n_words, n_removed added.

    Words: runs of other than ASCII white space, unchanged. Each word goes that a window covers whose words also start in a
    document of a smaller id, as the texts are given. Null texts have no words and become the empty text, as do texts of which
    all goes; texts shorter than a window stay whole but for their white space. Ids are whole numbers; a null id is larger than
    any other, and rows of equal ids (and of null ids) take nothing from each other. Rows that repeat are judged each. Columns
    of docs named n_words or n_removed give way; all others stay. An empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    spans = recurring(docs, id_col, text_col, window)
    of_id, of_hash, at, row_id, row_hash, made = fresh(docs, "of_id", "of_hash", "of_spans", "row_id", "row_hash", "made")
    spans = spans.select(F.col("id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("spans").alias(at))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn(row_id, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(row_hash, F.xxhash64(text))
    rows = rows.join(spans, (F.col(row_id) == F.col(of_id)) & (F.col(row_hash) == F.col(of_hash)), "left")
    rows = rows.withColumn(made, _kept(text, F.col(at)))
    kept = [F.col(f"{made}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    return rows.select(*kept, F.col(f"{made}.n_words").alias("n_words"), F.col(f"{made}.n_removed").alias("n_removed"))


def op12_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i,
         unnest(list_transform(generate_series(1, len(w) - 12), lambda j: array_to_string(w[j:j + 12], ' '))) AS s
  FROM d WHERE len(w) >= 13),
f AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS hit FROM k),
h AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM f WHERE hit),
o AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
m AS (SELECT o.doc_id, o.p, word, h.p IS NOT NULL AS gone FROM o LEFT JOIN h ON o.doc_id = h.doc_id AND o.p = h.p),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
