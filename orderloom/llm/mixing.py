"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash of their id and laid end to end, in up to `max_epochs` passes; that
stream of words is cut into blocks of `block_words` words. Slots are golden-ratio points: point i falls on the source into
whose part of the cumulative weights it falls, and the r-th slot of a source takes the r-th block of its stream. Any stretch of
slots therefore holds the sources close to their weights. A source ends where its target does: its last block is cut there,
slots after that one are void, and a source that the points give too few gets the missing ones after the last point. So targets are met to
the word at any size of corpus, source or block. Everything is DataFrame operations; running sums go over buckets
first, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, prefix_sum

#: Fixed value: the fractional part of the golden ratio, and that of 65536 times it, so that points stay precise.
GOLDEN, GOLDEN_HIGH = 0.6180339887498949, 0.4754867131087718
BUCKETS = 4096


def word_count(col: Column) -> Column:
    """Runs of characters other than white space, by the ASCII spaces alone; null: 0."""
    spaced = F.translate(F.coalesce(col, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """sizes: source, source_size, one row a source. Adds place, weight and target.

    A target stops at max_epochs times its source; what is over goes to the others by weight. With sources in the order
    of limit / weight those that stop come first, so the level of the rest follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "place")
    every = Window.partitionBy()
    so_far = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("used", F.coalesce(F.sum("most").over(so_far), F.lit(0.0)))
        .withColumn("used_weight", F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("used")) / (F.col("weights") - F.col("used_weight")))
        .withColumn("stops", F.col("most") / F.col("weight") <= F.col("level"))
    )
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    # the first source that does not stop has the highest level, and it holds for all after it
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * final)
    return ranked.withColumn("target", target).select("source", "place", "weight", "source_size", "target", "total")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, taken.

    Sources in code-point order, null last and a source of its own, take the weights in turn. Null texts have size 0 and
    take 0. Rows that repeat an id are laid out each. Other columns are not read. An empty table gives an empty result. Reruns
    agree, whatever the partitioning. Options: weights, max_epochs, block_words.
    """
    mixed = _mixed(docs, id_col, text_col, source_col, **options)
    return mixed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = 256) -> DataFrame:
    """id, text_hash, source, size, source_size, target, taken."""
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_hash, word_count(F.col(text_col)).alias("size"))
    sized = sized.withColumn("shuffle", F.xxhash64(F.lit("mix"), "id"))
    sized = materialize(sized, "sizes")
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "sources")

    laid = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    laid = laid.withColumn("bucket", F.shiftrightunsigned("shuffle", 52).cast("int"))
    laid = materialize(prefix_sum(laid, ["place"], "bucket", ["shuffle", "id", "text_hash"], "size", "start"), "laid")

    scheduled = materialize(schedule(sources, block_words), "schedule")
    block = F.lit(block_words)
    pass_start = F.col("pass") * F.col("source_size") + F.col("start")
    pieces = (
        laid.where("size > 0")
        .select("place", "start", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("pass"))
        .select("place", "start", pass_start.alias("from"), F.least(pass_start + F.col("size"), _words(F.col("target"))).alias("to"))
        .where(F.col("from") < F.col("to"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
        .withColumn("words", F.least(F.col("to"), (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block))
    )
    took = pieces.join(scheduled.hint("merge"), ["place", "block"]).groupBy("place", "start").agg(F.sum("words").alias("taken"))
    some = laid.where("size > 0").join(took, ["place", "start"], "left")
    none = laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["id", "text_hash", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return some.select(*columns).unionByName(none.select(*columns))


def _words(target: Column) -> Column:
    """A target in whole words."""
    return F.bround(target, 0).cast("long")


def schedule(sources: DataFrame, block_words: int, cells: int = 1024) -> DataFrame:
    """place, block, slot: which block of which source each slot takes; slots of points first, then those that were missing.

    Slots meet sources in one of `cells` equal cells of [0, 1), so the join has a key.
    """
    spark = sources.sparkSession
    share = F.sum(F.col("target") / F.col("total"))
    upto = share.over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    parts = sources.where("total > 0").withColumn("high", upto).withColumn("last", F.col("place") == F.max("place").over(Window.partitionBy()))
    parts = parts.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0.0)))
    parts = parts.withColumn("high", F.when(F.col("last"), F.lit(2.0)).otherwise(F.col("high")))
    first_cell, last_cell = F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    parts = parts.select("place", "low", "high", F.explode(F.sequence(first_cell, F.greatest(first_cell, last_cell))).alias("cell"))

    total = int(sources.agg(F.max("total")).first()[0] or 0)
    n = -(-total // block_words)
    slots = spark.range(n).withColumnRenamed("id", "slot")
    high, low = F.shiftright("slot", 16), F.col("slot").bitwiseAND(F.lit(0xFFFF))
    point = (high * F.lit(GOLDEN_HIGH) + low * F.lit(GOLDEN) + F.lit(0.5)) % 1.0
    slots = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    dealt = slots.join(parts, "cell").where("point >= low AND point < high").select("place", "slot", F.lit(1).cast("long").alias("one"))
    dealt = dealt.withColumn("bucket", F.floor(F.col("slot") / 4096))
    given = materialize(prefix_sum(dealt, ["place"], "bucket", ["slot"], "one", "block").select("place", "block", "slot"), "slots")

    wanted = sources.select("place", F.ceil(_words(F.col("target")) / block_words).alias("blocks"))
    had = given.groupBy("place").agg(F.count("*").alias("had"))
    short = wanted.join(had, "place", "left").select("place", F.coalesce("had", F.lit(0)).alias("had"), "blocks").where("had < blocks")
    missing = short.select("place", F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)).alias("block"))
    return given.unionByName(missing.select("place", "block", (F.lit(n) + F.col("block") * F.lit(1 << 20) + F.col("place")).alias("slot")))


def op6_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with how many words the mix takes of each: all their columns, then size, source_size, target, taken (columns of these names give way).

    The texts stay with their documents: one is emitted taken / size times. Every row stays, also null and empty texts (size and
    taken 0). Rows that repeat an id are laid out each; of rows that agree in id, source and text the one whose other columns
    are the first as JSON takes most. An empty table gives an empty result.
    """
    made = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c.lower() not in made]
    of_id, of_hash, of_source, of_place, hashed, place = names = fresh(docs, "of_id", "of_hash", "of_source", "of_place", "text_hash", "place")
    mixed = _mixed(docs.select("doc_id", "text", "source"), "doc_id", "text", "source")
    mixed = materialize(mixed.select(F.col("id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("source").alias(of_source), *made), "mixed")
    rows = docs.select(*kept, F.xxhash64(F.coalesce("text", F.lit(""))).alias(hashed))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & F.col("source").eqNullSafe(F.col(of_source)) & (F.col(hashed) == F.col(of_hash))
    if not mixed.groupBy(of_id, of_hash, of_source).count().where("count > 1").isEmpty():
        nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
        mixed = mixed.withColumn(of_place, nth([of_id, of_hash, of_source], F.desc("taken")))
        rows = rows.withColumn(place, nth(["doc_id", hashed, "source"], F.to_json(F.struct(*[c for c in kept if c != "text"]))))
        same = same & (F.col(place) == F.col(of_place))
    return rows.join(mixed, same).drop(*names).select(*kept, *made)
