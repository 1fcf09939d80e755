"""Order queues: signatures, statuses, refresh with protection, change detection, upserts, cancellation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signatures(lines: DataFrame, order: str, parts: list[str]) -> DataFrame:
    """A fingerprint of each order's lines that does not depend on their order."""
    line = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    return lines.groupBy(order).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("signature"), F.count("*").alias("n_lines"))


def duplicates(signed: DataFrame, order: str) -> DataFrame:
    """Orders whose signature others have: the first of them, and how many they are. Aggregated before it is joined back, so copies make no pairs."""
    groups = signed.groupBy("signature").agg(F.min(order).alias("first_order"), F.count("*").alias("n_orders")).where("n_orders > 1")
    return signed.join(groups, "signature").where(F.col(order) != F.col("first_order")).select(order, "first_order", "n_orders")


def rolled_up_status(lines: DataFrame, order: str, status: str, sent: str, error: str, pending: str) -> DataFrame:
    """all sent, any error, all pending, else mixed."""
    s = F.col(status)
    rolled = F.when(F.bool_and(s == sent), "SENT").when(F.bool_or(s == error), "ERROR").when(F.bool_and(s == pending), "PENDING").otherwise("MIXED")
    return lines.groupBy(order).agg(rolled.alias("rolled_status"), F.count("*").alias("n_lines"))


def refresh(queue: DataFrame, fresh: DataFrame, group: str, frozen: Column) -> DataFrame:
    """The queue with whole groups replaced by fresh ones, but for groups of which any row is frozen; those stay as they are."""
    kept_groups = queue.groupBy(group).agg(F.bool_or(frozen).alias("keep")).where("keep").select(group)
    kept = queue.join(kept_groups, group, "left_semi").withColumn("origin", F.lit("kept"))
    added = fresh.join(kept_groups, group, "left_anti").withColumn("origin", F.lit("fresh"))
    return kept.unionByName(added)


def changes(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that are new, gone or differ in any value (nulls compare as values)."""
    mark = F.sha2(F.to_json(F.struct(*values)), 256)
    side = lambda df, b, a: df.select(key, F.when(F.lit(b), mark).alias("b"), F.when(F.lit(a), mark).alias("a"))
    both = side(before, True, False).unionByName(side(after, False, True)).groupBy(key).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "change")


def upsert(store: DataFrame, edits: DataFrame, key: str, text: str, created: str) -> DataFrame:
    """The store after edits: an empty text deletes, a known key keeps when it was created, a new one is added."""
    e = edits.select(F.col(key), F.col(text).alias("new_text"), F.col(created).alias("new_created"), F.lit(True).alias("edited"))
    both = store.join(e, key, "full")
    value = F.when(F.col("edited"), F.col("new_text")).otherwise(F.col(text))
    return both.select(key, value.alias("__t"), F.coalesce(created, "new_created").alias(created)).where("__t is not null and __t <> ''").withColumnRenamed("__t", text)


def cancel_last(lines: DataFrame, requests: DataFrame, group: list[str], code: str, order_by: list, count: str) -> DataFrame:
    """Lines less the last k of each group and code that requests ask to cancel."""
    back = F.row_number().over(Window.partitionBy(*group, code).orderBy(*order_by))
    return lines.withColumn("back", back).join(requests, [*group, code], "left").where(F.col("back") > F.coalesce(count, F.lit(0))).drop("back", count)


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row fails; a check that is null fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def fill_down(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last value that is not null, from this row backwards."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
