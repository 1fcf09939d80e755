"""Queries over sales history."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import profiles
from ..sources.tables import table


def _facts(spark, sf_dir):
    """Order lines with client and article (brand)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)


_FACTS = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_SINCE = "(SELECT CAST(max(l_shipdate) AS DATE) - 30 FROM lineitem)"


def client_article_profile(spark, sf_dir):
    return profiles.client_article_profile(_facts(spark, sf_dir), "o_custkey", "p_brand", "l_quantity", "l_shipdate")


def client_sales_stats(spark, sf_dir):
    return profiles.client_stats(_facts(spark, sf_dir), "o_custkey", "o_orderkey", "l_extendedprice", "l_shipdate")


def global_catalogue_with_unsold(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= '2001-06-01'")
    sold = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_sold"), F.max(F.col("l_shipdate").cast("date")).alias("last_sold"), F.min(F.struct("l_shipdate", "l_quantity")).getField("l_quantity").alias("first_quantity"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return profiles.with_unsold(parts, sold, "p_partkey", ["n_sold"])


def active_clients(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


def inactive_clients(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate >= '2001-07-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name", "c_mktsegment")


def client_recency_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.count("*").alias("n_orders"))
    rows = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.col("last_order").desc(), F.col("n_orders").desc(), "c_custkey")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 80").select("c_nationkey", "c_custkey", "n_orders", "rank")


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    later = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("o_orderdate"))
    return o.withColumn("version", F.lit(0)).unionByName(later.withColumn("version", F.lit(1)))


def latest_order_version(spark, sf_dir):
    return profiles.latest_version(_versions(spark, sf_dir), ["o_orderkey"], ["o_orderdate", "version"])


def unique_owner_map(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.round("value", 0).cast("long").alias("amount"), "user_id")
    return profiles.unique_owner(e, "amount", "user_id")


def most_common_label(spark, sf_dir):
    return profiles.most_common(table(spark, sf_dir, "part"), ["p_brand"], "p_type")


def history_with_cutoff(spark, sf_dir):
    """Two feeds of facts added up, the second only up to a cutoff that keeps evaluation days out."""
    facts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_shipdate", "l_returnflag")
    feed = facts.where("l_returnflag = 'R'").unionByName(facts.where("l_returnflag = 'A' and l_shipdate < '1999-01-01'"))
    return feed.groupBy("l_partkey").agg(F.count("*").alias("n_lines"), profiles.money(F.col("l_quantity")).alias("volume"), F.max(F.col("l_shipdate").cast("date")).alias("last_date"))


def usual_quantities_top5(spark, sf_dir):
    """The five most usual quantities of each brand, as an array."""
    q = _facts(spark, sf_dir).groupBy("p_brand", "l_quantity").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    w = Window.partitionBy("p_brand").orderBy(F.col("n").desc(), F.col("last").desc(), F.col("l_quantity").desc())
    top = q.withColumn("r", F.row_number().over(w)).where("r <= 5")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "l_quantity"))), lambda x: x["l_quantity"])
    return top.groupBy("p_brand").agg(F.array_join(F.transform(ordered, lambda x: x.cast("int").cast("string")), ",").alias("quantities"))


def volume_bonus(spark, sf_dir):
    """Parts of a type within 8 points of the best size: with two or more of them, 6 ln(1 + sold) on top."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_sold"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").join(sold, "p_partkey", "left").withColumn("n_sold", F.coalesce("n_sold", F.lit(0)))
    # sizes of a brand are few, so its best and how many come near are aggregates of counts; rows only join them
    sizes = rows.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    best = sizes.join(sizes.groupBy("p_brand").agg(F.max("p_size").alias("best")), "p_brand").where(F.col("p_size") >= F.col("best") - 8)
    rows = rows.join(best.groupBy("p_brand", "best").agg(F.sum("n").alias("many")), "p_brand")
    bonus = F.when((F.col("p_size") >= F.col("best") - 8) & (F.col("many") >= 2), F.bround(6 * F.log1p(F.col("n_sold")), 4)).otherwise(F.lit(0.0))
    return rows.select("p_partkey", (F.col("p_size") + bonus).alias("score"), bonus.alias("bonus"))


def coverage_audit(spark, sf_dir):
    """Per order status: lines, lines whose article their client bought before, orders of which all lines are so."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    first = lines.groupBy("o_custkey", "p_brand").agg(F.min("o_orderdate").alias("first_date"))
    flagged = lines.join(first, ["o_custkey", "p_brand"]).withColumn("known", F.col("o_orderdate") > F.col("first_date"))
    per = flagged.groupBy("o_orderstatus", "o_orderkey").agg(F.count("*").alias("n"), F.count_if("known").alias("k"), F.bool_and("known").alias("a"))
    return per.groupBy("o_orderstatus").agg(F.sum("n").alias("n_lines"), F.sum("k").alias("n_known"), F.count_if("a").alias("n_covered_orders"), F.count("*").alias("n_orders"), F.round(F.sum("k") / F.sum("n"), 6).alias("known_rate"))


def last_orders_export(spark, sf_dir, n: int = 200):
    """The last n orders with their lines added up: a top-k report."""
    top = table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(n).select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return li.join(F.broadcast(top), li.l_orderkey == top.o_orderkey).groupBy("o_orderkey", "o_orderdate").agg(F.count("*").alias("n_lines"), profiles.money(F.col("l_extendedprice")).alias("amount"))


QUERIES = {f.__name__: f for f in (client_article_profile, client_sales_stats, global_catalogue_with_unsold, active_clients, inactive_clients, client_recency_rank, latest_order_version, unique_owner_map, most_common_label, history_with_cutoff, usual_quantities_top5, volume_bonus, coverage_audit, last_orders_export)}

SQL = {
    "client_article_profile": f"""
WITH q AS (SELECT o_custkey, p_brand, round(l_quantity, 3) AS q, count(*) AS n, count_if(CAST(l_shipdate AS DATE) >= {_SINCE}) AS r, max(CAST(l_shipdate AS DATE)) AS last
           FROM {_FACTS} GROUP BY ALL)
SELECT o_custkey, p_brand, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(r) AS BIGINT) AS n_recent, max(last) AS last_date,
       arg_max(q, (n, last, q)) FILTER (WHERE q > 0) AS usual_quantity, sum(CASE WHEN q > 0 THEN q * n ELSE 0.0 END) AS volume FROM q GROUP BY ALL""",
    "client_sales_stats": f"""
SELECT o_custkey, count(*) AS n_lines, count_if(CAST(l_shipdate AS DATE) >= {_SINCE}) AS n_recent_lines, count(DISTINCT o_orderkey) AS n_orders,
       count(DISTINCT CASE WHEN CAST(l_shipdate AS DATE) >= {_SINCE} THEN o_orderkey END) AS n_recent_orders, max(CAST(l_shipdate AS DATE)) AS last_date,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount_total,
       CAST(coalesce(sum(CASE WHEN CAST(l_shipdate AS DATE) >= {_SINCE} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS amount_recent
FROM {_FACTS} GROUP BY o_custkey""",
    "global_catalogue_with_unsold": """
SELECT p_partkey, p_name, p_brand, coalesce(n, 0) AS n_sold, last_sold, first_quantity FROM part LEFT JOIN (
  SELECT l_partkey, count(*) AS n, max(CAST(l_shipdate AS DATE)) AS last_sold, arg_min(l_quantity, (l_shipdate, l_quantity)) AS first_quantity
  FROM lineitem WHERE l_shipdate >= '2001-06-01' GROUP BY l_partkey) ON p_partkey = l_partkey""",
    "active_clients": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "inactive_clients": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '2001-07-01')",
    "client_recency_rank": """
SELECT c_nationkey, c_custkey, n_orders, rank FROM (
  SELECT c_nationkey, c_custkey, n_orders, row_number() OVER (PARTITION BY c_nationkey ORDER BY last_order DESC, n_orders DESC, c_custkey) AS rank
  FROM (SELECT o_custkey, max(o_orderdate) AS last_order, count(*) AS n_orders FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey) WHERE rank <= 80""",
    "latest_order_version": """
WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, 0 AS version FROM orders
           UNION ALL SELECT o_orderkey, o_custkey, 'X', o_orderdate + INTERVAL 2 DAY, 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, version FROM v QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, version DESC) = 1""",
    "unique_owner_map": "SELECT CAST(round(value, 0) AS BIGINT) AS amount, min(user_id) AS user_id FROM events GROUP BY 1 HAVING count(DISTINCT user_id) = 1",
    "most_common_label": """
SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1""",
    "history_with_cutoff": """
SELECT l_partkey, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, max(CAST(l_shipdate AS DATE)) AS last_date
FROM lineitem WHERE l_returnflag = 'R' OR (l_returnflag = 'A' AND l_shipdate < '1999-01-01') GROUP BY l_partkey""",
    "usual_quantities_top5": f"""
WITH q AS (SELECT p_brand, l_quantity, count(*) AS n, max(l_shipdate) AS last FROM {_FACTS} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, last DESC, l_quantity DESC) AS r FROM q)
SELECT p_brand, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY r) AS quantities FROM r WHERE r <= 5 GROUP BY p_brand""",
    "volume_bonus": """
WITH s AS (SELECT p_partkey, p_brand, p_size, coalesce(n, 0) AS n_sold FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
w AS (SELECT *, p_size >= max(p_size) OVER (PARTITION BY p_brand) - 8 AS near FROM s),
b AS (SELECT *, CASE WHEN near AND count_if(near) OVER (PARTITION BY p_brand) >= 2 THEN round_even(6 * ln(1 + n_sold), 4) ELSE 0.0 END AS bonus FROM w)
SELECT p_partkey, p_size + bonus AS score, bonus FROM b""",
    "coverage_audit": """
WITH l AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderdate > min(o_orderdate) OVER (PARTITION BY o_custkey, p_brand) AS known
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
p AS (SELECT o_orderstatus, o_orderkey, count(*) AS n, count_if(known) AS k, bool_and(known) AS a FROM l GROUP BY ALL)
SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(k) AS BIGINT) AS n_known, count_if(a) AS n_covered_orders, count(*) AS n_orders, round(sum(k) / sum(n), 6) AS known_rate FROM p GROUP BY 1""",
    "last_orders_export": """
SELECT o_orderkey, o_orderdate, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem JOIN (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) ON l_orderkey = o_orderkey GROUP BY ALL""",
}
