"""Aggregates of sales history: client by article profiles, client statistics, catalogues with what was never sold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(col: Column) -> Column:
    """Sums of cents are exact, in whatever order they are added."""
    return F.sum(col.cast("decimal(18,2)")).cast("double")


def recency_threshold(facts: DataFrame, date_col: str, days: int = 30) -> DataFrame:
    """One row: the date from which on a fact is recent, counted back from the last one."""
    return facts.agg(F.date_sub(F.max(date_col).cast("date"), days).alias("since"))


def client_article_profile(facts: DataFrame, client: str, article: str, quantity: str, date: str, days: int = 30) -> DataFrame:
    """Per client and article: lines, recent lines, last date, usual quantity (the most frequent; then the latest, then the largest) and volume.

    Two levels of partial aggregates: quantities first, so a task never holds a client.
    """
    since = recency_threshold(facts, date, days)
    day = F.col(date).cast("date")
    by_quantity = (
        facts.crossJoin(F.broadcast(since))  # one row
        .groupBy(client, article, F.round(quantity, 3).alias("q"))
        .agg(F.count("*").alias("n"), F.count_if(day >= F.col("since")).alias("recent"), F.max(day).alias("last"))
    )
    usual = F.max(F.when(F.col("q") > 0, F.struct("n", "last", "q")))
    return by_quantity.groupBy(client, article).agg(
        F.sum("n").alias("n_lines"), F.sum("recent").alias("n_recent"), F.max("last").alias("last_date"),
        usual.getField("q").alias("usual_quantity"), F.sum(F.when(F.col("q") > 0, F.col("q") * F.col("n")).otherwise(0.0)).alias("volume"),
    )


def client_stats(facts: DataFrame, client: str, order: str, amount: str, date: str, days: int = 30) -> DataFrame:
    """Per client: lines, orders and amounts, in all and recent; the last date. Orders are counted through a first level by order."""
    since = recency_threshold(facts, date, days)
    day = F.col(date).cast("date")
    recent = day >= F.col("since")
    cents = F.col(amount).cast("decimal(18,2)")
    per_order = facts.crossJoin(F.broadcast(since)).groupBy(client, order).agg(
        F.count("*").alias("n"), F.count_if(recent).alias("r"), F.max(day).alias("last"),
        F.sum(cents).alias("amount"), F.sum(F.when(recent, cents)).alias("recent_amount"),
    )
    return per_order.groupBy(client).agg(
        F.sum("n").alias("n_lines"), F.sum("r").alias("n_recent_lines"), F.count("*").alias("n_orders"), F.count_if(F.col("r") > 0).alias("n_recent_orders"),
        F.max("last").alias("last_date"), F.sum("amount").cast("double").alias("amount_total"), F.coalesce(F.sum("recent_amount"), F.lit(0)).cast("double").alias("amount_recent"),
    )


def with_unsold(catalogue: DataFrame, sold: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """The catalogue with counts of what was sold; zero for what never was."""
    return catalogue.join(sold, key, "left").select(*catalogue.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[c for c in sold.columns if c != key and c not in counts])


def latest_version(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of all versions of a key the last by `order`, whole. max_by over a struct is a partial aggregate, so nothing is sorted."""
    rest = [c for c in versions.columns if c not in key]
    picked = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return picked.select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])


def most_common(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; of equals the smallest."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("v")).select(*key, f"v.{value}", "v.n")


def unique_owner(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that exactly one owner has, with it. Least and greatest owner tell, so no set is built."""
    ends = rows.where(F.col(key).isNotNull() & F.col(owner).isNotNull()).groupBy(key).agg(F.min(owner).alias("a"), F.max(owner).alias("b"))
    return ends.where("a = b").select(key, F.col("a").alias(owner))
