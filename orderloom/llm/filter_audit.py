"""How filters of documents overlap, in every order in which they could run.

A document is reduced to its mask, one bit for each filter that it fails. Documents of the same part, mask and labels are
one cell with a count, so what follows does not grow with the corpus. Cells are unpivoted against every step of every
order (explode of a literal). A running bit-or over a cell's earlier steps says which filters it has failed before; from
that, conditional sums over the cells give the counts of a step, and a window over part and filter the total of all orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, UPPER, materialize, table

#: Beyond so many filters the orders of a cell are too many to list.
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """What filters A to D say of a text that is not null; true: it fails."""
    words = F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * upper.cast("long") > 10 * F.length(text).cast("long"),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def failures(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of docs: part, booleans A to E (true: fails), good, toxic.

    E: a row of smaller id has the same text, in the whole table. Texts are compared by their SHA-256; null counts as
    empty, a null part as the empty string, a null id as larger than any other; rows of one id don't repeat each other.
    good: some row of labels with that id has quality 1; toxic: some has toxic 1. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", *[c.alias(k) for k, c in text_failures(F.col("text")).items()], F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = materialize(rows, "filter-masks")
    # written first, so that both sides of the join are plain exchanges: adaptive execution splits a text of many copies only then
    least = materialize(rows.groupBy("digest").agg(F.min("id").alias("least")), "first-copies")
    repeats = F.col("least").isNotNull() & F.coalesce(F.col("id") > F.col("least"), F.lit(True))
    rows = rows.join(least, "digest").select("id", "part", *"ABCD", repeats.alias("E"))
    if labels is None:
        return rows.select("part", *"ABCDE", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    of = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    of = of.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.join(of, "id", "left").select("part", *"ABCDE", no("good"), no("toxic"))


def interaction(rows: DataFrame, filters: list[str], part_col: str = "part", good_col: str = "good", toxic_col: str = "toxic") -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part of rows and every order of filters.

    rows: a boolean column for each filter (true: fails; null: does not), named by one character each, and part, good and
    toxic. Counts within the part: kept after the step; removed by it; redundant, which fail its filter but are removed
    earlier; unique_fails, which fail its filter alone; good_lost and toxic_lost, of those removed; shapley, removed by
    the filter in all orders together. Rows that repeat count each; an empty table gives an empty result.
    """
    if not 0 < len(filters) <= MOST_FILTERS or any(len(f) != 1 for f in filters) or len(set(filters)) != len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters of one character each")
    letters = "".join(filters)
    mask = sum((F.when(F.col(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    cell = ["part", "mask", "good", "toxic"]
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    cells = rows.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.alias("mask"), true(good_col).alias("good"), true(toxic_col).alias("toxic"))
    cells = cells.groupBy(*cell).agg(F.count("*").alias("docs"))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(letters) + 1)))))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)]), F.col("letter"))
    steps = steps.withColumn("bit", bit).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy(*cell, "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))

    fails, first = F.col("failed") != 0, F.col("earlier") == 0
    total = lambda which, name: F.sum(F.when(which, F.col("docs")).otherwise(0)).alias(name)
    found = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & first, "kept"), total(fails & first, "removed"), total(fails & ~first, "redundant"), total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(fails & first & F.col("good"), "good_lost"), total(fails & first & F.col("toxic"), "toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def op13_filter_audit(spark, sf_dir):
    rows = failures(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return interaction(rows, list("ABCDE"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
b AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 100)::INT AS "A", (100 * len(list_distinct(w)) < 80 * len(w))::INT AS "B",
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT AS "C",
         regexp_matches(t, '[#$%&*|]')::INT AS "D", (d.doc_id > least)::INT AS "E"
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
g AS (SELECT part, good, toxic, {'A': "A", 'B': "B", 'C': "C", 'D': "D", 'E': "E"} AS m, count(*) AS n FROM b GROUP BY ALL),
x AS (
  SELECT part, good, toxic, n, o, step, o[step] AS f,
         list_transform([1, 2, 3, 4, 5], lambda i: CASE o[i] WHEN 'A' THEN m."A" WHEN 'B' THEN m."B" WHEN 'C' THEN m."C" WHEN 'D' THEN m."D" ELSE m."E" END) AS r
  FROM g, s),
y AS (SELECT *, r[step] = 1 AS fails, coalesce(list_sum(r[1:step - 1]), 0) > 0 AS gone, list_sum(r) = 1 AS alone FROM x),
z AS (
  SELECT part, o AS filter_order, step, f, sum(n) FILTER (WHERE NOT fails AND NOT gone) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed,
         sum(n) FILTER (WHERE fails AND gone) AS redundant, sum(n) FILTER (WHERE fails AND alone) AS unique_fails,
         sum(n) FILTER (WHERE fails AND NOT gone AND good = 1) AS good_lost, sum(n) FILTER (WHERE fails AND NOT gone AND toxic = 1) AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM z
"""
