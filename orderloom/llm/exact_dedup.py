"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg's naming, run as Spark joins).

A text is cut into blocks of a fixed size. The distinct blocks are sorted, and their place in that order is their
integer name; then adjacent names are paired, the distinct pairs sorted and named in turn, until each text has one
name. Two texts have the same name if and only if they are equal: names come from comparing whole blocks, never from
a hash, so nothing can collide. Only blocks that occur more than once need names, as a text with a block that no
other text has is equal to no other. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize


def normalised(col):
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE + r"{2,}|[\x09-\x0D]", " ")


def _names(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys and name, for those keys that occur more than once: an integer that follows the order of the keys in each partition."""
    often = values.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return materialize(often.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts equal empty ones. Of equal texts the smallest id stays; a null id stays only if all ids of its group are
    null. Rows that repeat an id are counted each, and each repeats the answer of that id. Other columns of docs are
    not read. An empty table gives an empty result. Texts of any length are cut linearly.
    """
    norm = normalised(F.col(text_col))
    parts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("row", F.monotonically_increasing_id())
    parts = parts.select("row", "id", F.sha2("norm", 256).alias("sha"), F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), 0).alias("parts"))
    parts = parts.select("row", "id", "sha", F.when(F.size("parts") == 0, F.array(F.lit(""))).otherwise(F.col("parts")).alias("parts"))
    blocks = parts.select("row", "id", "sha", F.size("parts").alias("n_blocks"), F.posexplode("parts").alias("pos", "block"))
    at_first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    blocks = blocks.select("row", at_first("id"), at_first("sha"), "n_blocks", "pos", "block")

    names = _names(blocks, ["block"])
    named = materialize(blocks.join(names, "block", "left").select("row", "id", "sha", "n_blocks", "pos", "name"), "named-blocks")
    discard(names)

    heads = named.where("pos = 0")
    single = heads.where("n_blocks = 1").select("id", "sha", F.lit(0).alias("depth"), "name")
    many = _all_named(named.where("n_blocks > 1").select("row", "pos", "name"))
    longest = many.agg(F.max("pos")).first()[0] or 0
    for _ in range(longest.bit_length()):
        pairs = many.groupBy("row", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = materialize(pairs, "pairs")
        names = _names(pairs, ["left", "right"])
        after = materialize(_all_named(pairs.join(names, ["left", "right"], "left")), "named-pairs")
        discard(names, pairs, many)
        many = after
    whole = heads.where("n_blocks > 1").select("row", "id", "sha").join(many.select("row", "name"), "row", "left")

    rows = single.unionByName(whole.select("id", "sha", F.lit(1).alias("depth"), "name"))
    shared = rows.where("name is not null")
    groups = shared.groupBy("depth", "name").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    alone = rows.where("name is null").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    every = alone.unionByName(shared.join(groups, ["depth", "name"]).select("id", "sha", "keep_id", "group_size"))
    return every.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _all_named(parts: DataFrame) -> DataFrame:
    """Only the parts of those texts of which every part has a name."""
    lacking = parts.where("name is null").select("row").distinct()
    return parts.join(lacking, "row", "left_anti").select("row", "pos", "name")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
