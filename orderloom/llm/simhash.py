"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint bit i gets a nonzero vector phi(i) of radius + 1 bits, and each nonzero vector v gives one table, whose mask
keeps the bits i with an odd number of common ones in phi(i) and v. At most `radius` differing bits give at most
`radius` linear equations in radius + 1 unknowns, so some v is orthogonal to all their vectors: its mask drops every
differing bit, and the pair collides there for certain. The 2^(radius+1) - 1 masks keep about half of the bits each.

Documents with equal fingerprints are one node. In each bucket every node is first held against the bucket's smallest
node, a number of pairs linear in the nodes; components of those links follow. Only buckets that then still hold more
than one component are compared further: small ones by a join, large ones as pairs of bounded blocks inside tasks, which
give back no more links than they have nodes. No bucket is capped, and no link between components is lost.
"""

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components
from .shingles import one_of_each
from .words import majority, shingle_hashes, signed, texts_of, words_of

SMALL_BUCKET, BLOCK = 16, 1024


@functools.cache
def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits. Which vectors the bits get is a matter of the stride: that one
    whose emptiest mask keeps most bits, as a mask of few bits would put everything into a few buckets."""
    vectors = (1 << radius + 1) - 1

    def masks(stride: int) -> list[int]:
        phi = [1 + i * stride % vectors for i in range(bits)]
        return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]

    return max(map(masks, range(1, vectors + 1)), key=lambda m: min(x.bit_count() for x in m))


def signatures(shingle_words: int) -> Callable:
    """An Arrow function from a text column to one-element arrays: the fingerprint of its shingles, repeats included."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<long>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = [majority(shingle_hashes(words_of(t), shingle_words)) for t in texts_of(texts)]
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32), pa.array(signed(found)))

    return fingerprint


def _long(value: int) -> Column:
    return F.lit(int(np.uint64(value).astype(np.int64)))


def near_links(nodes: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """nodes: node, sig (array of 64-bit fingerprints). Links join all nodes that differ by radii[i] bits or fewer in sig[i],
    for each i (radii over 64 count all fingerprints from i on as one). Returns node, root for every node that has a link.
    """
    spark = nodes.sparkSession
    masks = covering_masks(radii[0])
    keys = F.array(*[F.xxhash64(F.lit(v), F.col("sig")[0].bitwiseAND(_long(m))) for v, m in enumerate(masks)])
    rows = nodes.select("node", F.col("sig")[0].alias("coarse"), F.explode(keys).alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("least"), F.min_by("coarse", "node").alias("least_coarse"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(buckets, "key"), "buckets")

    near = F.bit_count(F.col("coarse").bitwiseXOR(F.col("least_coarse"))) <= radii[0]
    close = shared.where((F.col("node") != F.col("least")) & near).select("node", "least").distinct()
    if len(radii) > 1:
        a, b = nodes.select("node", F.col("sig").alias("sig_a")), nodes.select(F.col("node").alias("least"), F.col("sig").alias("sig_b"))
        close = close.join(a, "node").join(b, "least").where(_close(F.col("sig_a"), F.col("sig_b"), radii))
    first = materialize(close.select(F.col("node").alias("a"), F.col("least").alias("b")), "star-links")
    roots = materialize(components(first), "roots")

    labelled = shared.join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = materialize(labelled.join(mixed, "key").join(nodes, "node").select("key", "n", "root", "sig"), "mixed-buckets")
    discard(shared)

    small = left.where(F.col("n") <= SMALL_BUCKET).select("key", "root", "sig").distinct()
    other = small.select("key", F.col("root").alias("root_b"), F.col("sig").alias("sig_b"))
    small = small.join(other, "key").where((F.col("root") < F.col("root_b")) & _close(F.col("sig"), F.col("sig_b"), radii))
    small = small.select(F.col("root").alias("a"), F.col("root_b").alias("b"))

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = left.where(F.col("n") > SMALL_BUCKET).withColumn("block", F.pmod(F.xxhash64("sig"), blocks).cast("int"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "root", "sig")
    large = large.groupBy("key", "i", "j").applyInPandas(_spanning(radii), "a long, b long")
    second = materialize(small.unionByName(large).distinct(), "cross-links")
    discard(left)
    return materialize(components(first.unionByName(second)), "components")


def _close(a: Column, b: Column, radii: tuple[int, ...]) -> Column:
    near = F.bit_count(a[0].bitwiseXOR(b[0])) <= radii[0]
    if len(radii) > 1:
        rest = F.aggregate(F.slice(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), 2, 63), F.lit(0), lambda s, x: s + x)
        near = near & (rest <= radii[1])
    return near


def _spanning(radii: tuple[int, ...]) -> Callable:
    """Of the links across components within a group of two blocks, enough to join what they join."""

    def compare(group):
        import pandas as pd

        sig = np.stack(group["sig"].to_numpy()).view(np.uint64)
        root, kept = group["root"].to_numpy(), []
        at = {int(r): int(r) for r in root}

        def find(x: int) -> int:
            while at[x] != x:
                at[x] = at[at[x]]
                x = at[x]
            return x

        for i in range(len(sig) - 1):
            others = np.flatnonzero((root[i + 1 :] != root[i]) & (np.bitwise_count(sig[i + 1 :, 0] ^ sig[i, 0]) <= radii[0])) + i + 1
            if len(radii) > 1 and len(others):
                others = others[np.bitwise_count(sig[others, 1:] ^ sig[i, 1:]).sum(axis=1) <= radii[1]]
            for r in np.unique(root[others]).tolist():
                x, y = find(int(root[i])), find(r)
                if x != y:
                    at[max(x, y)] = min(x, y)
                    kept.append((x, y))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return compare


def group_near(docs: DataFrame, signature: Column, radii: tuple[int, ...], id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, sig, component_id, the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link as any other does. Null ids are never a component's id unless it has
    no other. Rows that repeat an id stay. An empty table gives an empty result.
    """
    signed_docs = materialize(docs.select(F.col(id_col).alias("id"), signature.alias("sig")), "fingerprints")
    nodes = signed_docs.groupBy("sig").agg(F.min("id").alias("least_id"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = near_links(nodes.select("node", "sig"), radii)
    linked = nodes.join(roots, "node").select("sig", "least_id", "root")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = linked.join(least, "root").select("sig", "component_id")
    alone = nodes.join(roots, "node", "left_anti").select("sig", F.col("least_id").alias("component_id"))
    return signed_docs.join(found.unionByName(alone), "sig").select(F.col("id").alias(id_col), "sig", "component_id")


def op2_simhash(spark, sf_dir, shingle_words: int = 3, radius: int = 3):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    grouped = group_near(docs, signatures(shingle_words)(F.col("text")), (radius,))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex(F.col("sig")[0]), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id, with all its columns, whatever those are called.

    Candidates are texts whose SimHash fingerprints of 2048 bits agree in a table and are near; the sets of shingles confirm them. At that similarity 15 in 100
    bits differ, so a covering of all masks, as in near_links(), would keep no bits enough to tell texts apart: tables sample bits instead (see shingles).
    Null and empty texts and those without words are copies of each other: one stays. Of rows that repeat, or repeat an id and a text, one
    stays; of a group's rows that share its smallest id, the one with the smallest text hash. A null id comes after all others. Columns of
    any type are carried along. An empty table gives an empty result.
    """
    return one_of_each(docs)
