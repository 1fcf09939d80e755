"""Queries that hold predicted order lines against true ones. Predictions are the true lines, some of them dropped or altered by arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import hash_bucket
from ..operators import evaluation
from ..sources.tables import table


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("l_quantity"), "l_suppkey", "l_linestatus")


def _truth(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity")


def _predicted(spark, sf_dir, salt: int = 0):
    h = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey") + salt) % 10
    rows = _lines(spark, sf_dir).withColumn("h", h).where("h <> 0")
    part = F.when(F.col("h") == 2, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    quantity = F.when(F.col("h") == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return rows.select("l_orderkey", part.alias("l_partkey"), quantity.alias("l_quantity"))


_T = "t AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem)"


def _p(salt: int = 0, name: str = "p") -> str:
    h = f"(l_orderkey * 7 + l_partkey * 13 + l_suppkey + {salt}) % 10"
    return f"{name} AS (SELECT l_orderkey, CASE WHEN {h} = 2 THEN l_partkey + 1 ELSE l_partkey END AS l_partkey, CAST(l_quantity AS BIGINT) + CASE WHEN {h} = 1 THEN 1 ELSE 0 END AS l_quantity FROM lineitem WHERE {h} <> 0)"


_C = """c AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_quantity, b.l_quantity) AS l_quantity, coalesce(a.n, 0) AS nt, coalesce(b.n, 0) AS np
FROM (SELECT *, count(*) AS n FROM t GROUP BY ALL) a FULL JOIN (SELECT *, count(*) AS n FROM p GROUP BY ALL) b USING (l_orderkey, l_partkey, l_quantity))"""
_R = """k AS (SELECT l_orderkey, l_partkey, sum(nt) AS ct, sum(np) AS cp, sum(least(nt, np)) AS m FROM c GROUP BY ALL),
r0 AS (SELECT l_orderkey, CAST(sum(ct) AS BIGINT) AS n_truth, CAST(sum(cp) AS BIGINT) AS n_predicted, CAST(sum(least(ct, cp)) AS BIGINT) AS code_matches, CAST(sum(m) AS BIGINT) AS exact_matches FROM k GROUP BY 1),
r AS (SELECT *, n_truth - exact_matches AS n_missing, n_predicted - exact_matches AS n_extra, n_truth > 0 AND exact_matches = n_truth AND exact_matches = n_predicted AS perfect,
 CASE WHEN exact_matches = n_truth AND exact_matches = n_predicted THEN 'none' WHEN n_predicted = 0 THEN 'no_prediction' WHEN n_truth = 0 THEN 'no_truth'
      WHEN code_matches = n_truth AND code_matches = n_predicted THEN 'quantity' WHEN code_matches = n_truth AND n_predicted > n_truth THEN 'extra_lines'
      WHEN code_matches = n_predicted AND n_truth > n_predicted THEN 'missing_lines' ELSE 'wrong_articles' END AS cause FROM r0)"""


def order_compare_records(spark, sf_dir):
    return evaluation.compare_orders(_truth(spark, sf_dir), _predicted(spark, sf_dir), "l_orderkey", "l_partkey", "l_quantity")


def micro_metrics_by_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return evaluation.micro_metrics(order_compare_records(spark, sf_dir).join(o, "l_orderkey"), "o_orderpriority")


def error_causes(spark, sf_dir):
    return order_compare_records(spark, sf_dir).groupBy("cause").agg(F.count("*").alias("n_orders"), F.sum("n_missing").alias("n_missing"), F.sum("n_extra").alias("n_extra"))


def missing_extra_expanded(spark, sf_dir):
    return evaluation.expanded_differences(_truth(spark, sf_dir), _predicted(spark, sf_dir), ["l_orderkey", "l_partkey", "l_quantity"])


def aligned_full_outer(spark, sf_dir):
    return evaluation.aligned_occurrences(_truth(spark, sf_dir), _predicted(spark, sf_dir), "l_orderkey", "l_partkey", "l_quantity")


def version_diff_gain_regression(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_quantity"]
    return evaluation.version_changes(_predicted(spark, sf_dir), _predicted(spark, sf_dir, 3), _truth(spark, sf_dir), keys)


def reliability_buckets(spark, sf_dir):
    """Each predicted line counted under several labels at once, and how many of them are correct."""
    p = evaluation.consumed_matches(_predicted(spark, sf_dir), _truth(spark, sf_dir), ["l_orderkey", "l_partkey", "l_quantity"], ["l_quantity"])
    decile = F.concat(F.lit("quantity "), F.least(F.floor(F.col("l_quantity") / 10) * 10, F.lit(40)).cast("string"))
    labels = F.array(F.lit("all"), decile, F.concat(F.lit("part "), (F.col("l_partkey") % 5).cast("string")), F.concat(F.lit("order "), (F.col("l_orderkey") % 3).cast("string")))
    return p.select(F.explode(labels).alias("bucket"), "correct").groupBy("bucket").agg(F.count("*").alias("n_lines"), F.count_if("correct").alias("n_correct"), F.round(F.count_if("correct") / F.count("*"), 4).alias("precision"))


def threshold_sweep(spark, sf_dir):
    """Precision and coverage of the predicted lines at or above each threshold of quantity, from one histogram."""
    p = evaluation.consumed_matches(_predicted(spark, sf_dir), _truth(spark, sf_dir), ["l_orderkey", "l_partkey", "l_quantity"], ["l_quantity"])
    histogram = p.groupBy("l_quantity").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    reached = histogram.withColumn("threshold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(50), F.lit(5)), lambda t: t <= F.col("l_quantity"))))
    return reached.groupBy("threshold").agg(F.sum("n").alias("n_lines"), F.sum("c").alias("n_correct"), F.round(F.sum("c") / F.sum("n"), 4).alias("precision"))


def substitution_mining(spark, sf_dir):
    return evaluation.substitutions(_truth(spark, sf_dir), _predicted(spark, sf_dir), "l_orderkey", "l_partkey")


def topn_candidate_recall(spark, sf_dir):
    """How often the brand that a nation sells most of is among its n best by lines, by the rank of each of its suppliers' parts."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_suppkey").orderBy(F.col("n").desc(), "l_partkey")
    ranked = sold.withColumn("rank", F.row_number().over(w))
    expected = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_partkey").alias("l_partkey"))
    found = expected.join(ranked, ["l_suppkey", "l_partkey"], "left")
    return found.agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"top_{k}") for k in (1, 3, 5, 10)])


def hash_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.select("c_custkey", hash_bucket(F.col("c_name")).alias("bucket"), F.when(hash_bucket(F.col("c_name")) < 20, "holdout").otherwise("train").alias("split"))


def temporal_holdout(spark, sf_dir, n: int = 500):
    """The newest n orders are held out. The n are a top-k; the rest is told from them by an anti join."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    newest = o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(n).select("o_orderkey", F.lit(True).alias("held_out"))
    return o.join(F.broadcast(newest), "o_orderkey", "left").select("o_orderkey", F.coalesce("held_out", F.lit(False)).alias("held_out"))


def prediction_overlay(spark, sf_dir):
    """Base lines with those of a second version added whose code the base order does not have."""
    base, second = _predicted(spark, sf_dir), _predicted(spark, sf_dir, 3)
    added = second.join(base.select("l_orderkey", "l_partkey").distinct(), ["l_orderkey", "l_partkey"], "left_anti")
    both = base.withColumn("origin", F.lit("base")).unionByName(added.withColumn("origin", F.lit("added")))
    return both.groupBy("l_orderkey", "origin").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))


QUERIES = {f.__name__: f for f in (order_compare_records, micro_metrics_by_split, error_causes, missing_extra_expanded, aligned_full_outer, version_diff_gain_regression, reliability_buckets, threshold_sweep, substitution_mining, topn_candidate_recall, hash_split, temporal_holdout, prediction_overlay)}
_M = "m AS (SELECT p.*, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_quantity ORDER BY l_quantity) <= coalesce(h.have, 0) AS correct FROM p LEFT JOIN (SELECT *, count(*) AS have FROM t GROUP BY ALL) h USING (l_orderkey, l_partkey, l_quantity))"
SQL = {
    "order_compare_records": f"WITH {_T}, {_p()}, {_C}, {_R} SELECT * FROM r",
    "micro_metrics_by_split": f"""WITH {_T}, {_p()}, {_C}, {_R}
SELECT o_orderpriority, count(*) AS n_orders, round(sum(code_matches) / sum(n_truth), 4) AS code_recall, round(sum(code_matches) / sum(n_predicted), 4) AS code_precision,
 round(sum(exact_matches) / sum(n_truth), 4) AS line_recall, round(sum(exact_matches) / sum(n_predicted), 4) AS line_precision, round(count_if(perfect) / count(*), 4) AS perfect_rate
FROM r JOIN orders ON l_orderkey = o_orderkey WHERE n_truth > 0 GROUP BY ROLLUP (o_orderpriority)""",
    "error_causes": f"WITH {_T}, {_p()}, {_C}, {_R} SELECT cause, count(*) AS n_orders, CAST(sum(n_missing) AS BIGINT) AS n_missing, CAST(sum(n_extra) AS BIGINT) AS n_extra FROM r GROUP BY 1",
    "missing_extra_expanded": f"""WITH {_T}, {_p()}, {_C}
SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN nt > np THEN 'missing' ELSE 'extra' END AS side, unnest(range(1, abs(nt - np) + 1)) AS copy FROM c WHERE nt <> np""",
    "aligned_full_outer": f"""WITH {_T}, {_p()},
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity) AS occurrence FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity) AS occurrence FROM p)
SELECT l_orderkey, l_partkey, occurrence, a.l_quantity AS truth_value, b.l_quantity AS predicted_value,
 CASE WHEN a.l_quantity IS NULL THEN 'predicted only' WHEN b.l_quantity IS NULL THEN 'truth only' ELSE 'both' END AS tag FROM a FULL JOIN b USING (l_orderkey, l_partkey, occurrence)""",
    "version_diff_gain_regression": f"""WITH {_T}, {_p(0, 'o')}, {_p(3, 'n')},
d AS (SELECT l_orderkey, l_partkey, l_quantity, CAST(sum(x) AS BIGINT) AS change FROM (SELECT *, -1 AS x FROM o UNION ALL SELECT *, 1 FROM n) GROUP BY ALL HAVING sum(x) <> 0)
SELECT d.*, t.l_orderkey IS NOT NULL AS true_line, CASE WHEN change > 0 AND t.l_orderkey IS NOT NULL THEN 'gain' WHEN change > 0 THEN 'false addition' WHEN t.l_orderkey IS NOT NULL THEN 'regression' ELSE 'cleanup' END AS label
FROM d LEFT JOIN (SELECT DISTINCT * FROM t) t ON d.l_orderkey = t.l_orderkey AND d.l_partkey = t.l_partkey AND d.l_quantity = t.l_quantity""",
    "reliability_buckets": f"""WITH {_T}, {_p()}, {_M},
x AS (SELECT unnest(['all', 'quantity ' || least(l_quantity // 10 * 10, 40), 'part ' || l_partkey % 5, 'order ' || l_orderkey % 3]) AS bucket, correct FROM m)
SELECT bucket, count(*) AS n_lines, count_if(correct) AS n_correct, round(count_if(correct) / count(*), 4) AS precision FROM x GROUP BY 1""",
    "threshold_sweep": f"""WITH {_T}, {_p()}, {_M}
SELECT CAST(threshold AS INT) AS threshold, count(*) AS n_lines, count_if(correct) AS n_correct, round(count_if(correct) / count(*), 4) AS precision FROM m JOIN range(0, 51, 5) s(threshold) ON l_quantity >= threshold GROUP BY 1""",
    "substitution_mining": f"""WITH {_T}, {_p()}, a AS (SELECT DISTINCT l_orderkey, l_partkey AS k FROM t), b AS (SELECT DISTINCT l_orderkey, l_partkey AS k FROM p),
x AS (SELECT l_orderkey, k, 1 AS m FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT l_orderkey, k, 0 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)),
o AS (SELECT l_orderkey, min(k) FILTER (WHERE m = 0) AS extra, min(k) FILTER (WHERE m = 1) AS missing FROM x GROUP BY 1 HAVING count_if(m = 1) = 1 AND count_if(m = 0) = 1)
SELECT extra, missing, count(*) AS support FROM o GROUP BY ALL HAVING count(*) >= 2""",
    "topn_candidate_recall": """
WITH s AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank FROM s)
SELECT count(*) AS n, count_if(rank <= 1) AS top_1, count_if(rank <= 3) AS top_3, count_if(rank <= 5) AS top_5, count_if(rank <= 10) AS top_10
FROM (SELECT l_suppkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) LEFT JOIN r USING (l_suppkey, l_partkey)""",
    "hash_split": """
SELECT c_custkey, CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) % 100 AS bucket, CASE WHEN CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) % 100 < 20 THEN 'holdout' ELSE 'train' END AS split FROM customer""",
    "temporal_holdout": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 500 AS held_out FROM orders",
    "prediction_overlay": f"""WITH {_p(0, 'b')}, {_p(3, 's')}, u AS (SELECT l_orderkey, l_quantity, 'base' AS origin FROM b UNION ALL SELECT l_orderkey, l_quantity, 'added' FROM s WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM b))
SELECT l_orderkey, origin, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM u GROUP BY ALL""",
}
