"""Queries that keep, merge, choose and audit records: the smaller steps of the order flow."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.tables import table
from .queues import _E, _edges


def sendable_orders(spark, sf_dir):
    """Orders of which every line is open and of a supported unit, and orders that have no line."""
    li = table(spark, sf_dir, "lineitem")
    ok = li.groupBy("l_orderkey").agg(F.bool_and((F.col("l_linestatus") == "O") & (F.col("l_partkey") % 9 != 0)).alias("all_ok"), F.count("*").alias("n_lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(ok, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.where("all_ok or all_ok is null").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def canonical_references(spark, sf_dir):
    """Part keys by what they stand for: the least unmarked key of the name and brand, for keys that are marked as duplicates; else their own."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", (F.col("p_partkey") % 4 == 0).alias("marked"))
    official = p.where("not marked").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("official"), F.count("*").alias("n"))
    found = p.join(official, ["p_name", "p_brand"], "left")
    return found.select("p_partkey", F.when(F.col("marked") & (F.col("n") == 1), F.col("official")).otherwise(F.col("p_partkey")).alias("canonical"))


def segment_association(spark, sf_dir):
    """Turns with their conversation's opening turn by id; where the id is lost, by text, if only one opening has it."""
    c = table(spark, sf_dir, "conversations")
    openings = c.where("turn = 0").select(F.col("conv_id").alias("opening"), "text")
    by_text = openings.groupBy("text").agg(F.min("opening").alias("by_text"), F.count("*").alias("n")).where("n = 1").drop("n")
    asked = c.where("turn = 0").select("conv_id", "turn", "text", F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("known"))
    found = asked.join(by_text, "text", "left")
    return found.select("conv_id", F.coalesce("known", "by_text").alias("opening"))


def strict_pairs(spark, sf_dir):
    """Suppliers' best customers at 0.6 or more that are 0.05 ahead of the next; a lone candidate needs no lead."""
    w = Window.partitionBy("s_suppkey").orderBy(F.col("score").desc(), "c_custkey")
    e = _edges(spark, sf_dir).withColumn("place", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    return e.where((F.col("place") == 1) & (F.col("score") >= 0.6) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= 0.05))).select("s_suppkey", "c_custkey", "score")


def merged_alternatives(spark, sf_dir):
    """Views with the click that follows them at once: the click is taken up by the view and goes as a row."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("next_type", F.lead("event_type").over(w)).withColumn("next_id", F.lead("event_id").over(w)).withColumn("before", F.lag("event_type").over(w))
    kept = e.where(~((F.col("event_type") == "click") & (F.coalesce("before", F.lit("")) == "view")))
    return kept.select("event_id", F.when((F.col("event_type") == "view") & (F.col("next_type") == "click"), F.col("next_id")).alias("alternative"))


def first_of_repeated(spark, sf_dir):
    """First events of a kind that comes again, for users who once had a kind twice in a row and of whom two kinds or more come again; all events of the others."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    kinds = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count_if(F.col("n") >= 2).alias("again"))
    in_row = e.withColumn("row", F.col("event_type") == F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).groupBy("user_id").agg(F.max("row").alias("row"))
    storm = kinds.join(in_row, "user_id").select("user_id", ((F.col("again") >= 2) & F.coalesce("row", F.lit(False))).alias("storm"))
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.withColumn("place", first).join(storm, "user_id").where("not storm or place = 1").select("event_id")


def alias_union(spark, sf_dir):
    """The segments of a nation's customers and the types of its suppliers' parts, as one sorted set."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias("a"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set(F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string"))).alias("b"))
    empty = F.array().cast("array<string>")
    both = table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return both.select("n_nationkey", F.array_join(F.array_sort(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty))), ",").alias("aliases"))


def merged_histories(spark, sf_dir):
    """Histories under keys that differ in case and spaces only, as one."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("segment"), "c_custkey")
    return c.groupBy(F.upper(F.trim("segment")).alias("segment")).agg(F.count("*").alias("n_customers"), F.max("c_custkey").alias("last_customer"))


def replaced_groups(spark, sf_dir):
    """Orders with those of some customers replaced by one new row each."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("o_custkey"), (-F.col("c_custkey")).alias("o_orderkey"), F.lit("new").alias("origin"))
    return o.join(new.select("o_custkey"), "o_custkey", "left_anti").unionByName(new)


def word_budget(spark, sf_dir, budget: int = 3000):
    """The first turns of each conversation as far as a budget of characters reaches."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    so_far = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("so_far", so_far).where(F.col("so_far") <= budget).select("conv_id", "turn", "so_far")


def suspicious_turns(spark, sf_dir):
    """Turns that look cut off or like long lists: no closing mark, or many commas."""
    c = table(spark, sf_dir, "conversations")
    commas = F.regexp_count("text", F.lit(","))
    return c.select("conv_id", "turn", (~F.col("text").rlike(r"[.!?]\s*$")).alias("open_end"), (commas >= 4).alias("long_list"))


def key_audit(spark, sf_dir):
    """Keys that repeat and keys that the other side lacks, counted: orders against lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    lines = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("n") > 1).alias("repeats"), F.lit(0).alias("o"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("repeats"), F.lit(1).alias("o"))
    both = lines.withColumn("l", F.lit(1)).unionByName(orders.withColumn("l", F.lit(0))).groupBy("k").agg(F.sum("repeats").alias("repeats"), F.sum("o").alias("o"), F.sum("l").alias("l"))
    return both.agg(F.sum("repeats").alias("n_repeated_keys"), F.count_if((F.col("o") > 0) & (F.col("l") == 0)).alias("n_orders_without_lines"), F.count_if((F.col("o") == 0) & (F.col("l") > 0)).alias("n_lines_without_order"))


def truth_by_client_and_day(spark, sf_dir):
    """Orders of two feeds by client and day, the first of all orders, the later of every third: the label of the later feed wins, within a feed that of the larger key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_orderpriority")
    feeds = o.withColumn("feed", F.lit(0)).unionByName(o.where("o_orderkey % 3 = 0").withColumn("feed", F.lit(1)))
    return feeds.groupBy("o_custkey", "day").agg(F.max_by("o_orderpriority", F.struct("feed", "o_orderkey")).alias("label"), F.count("*").alias("n"))


def order_headers(spark, sf_dir):
    """The header of each order from its first line by key: supplier, part and day."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), "l_quantity")
    h = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "day"))
    return li.groupBy("l_orderkey").agg(h.alias("h")).select("l_orderkey", "h.l_partkey", "h.l_suppkey", "h.day")


def token_differences(spark, sf_dir):
    """Tokens that one of two like names has and the other has not."""
    from .texts import _name_pairs

    d = F.array_union(F.array_except("tokens", "other_tokens"), F.array_except("other_tokens", "tokens"))
    return _name_pairs(spark, sf_dir).select("p_name", "other", F.array_join(F.array_sort(d), ",").alias("difference"))


def class_means(spark, sf_dir):
    """Means and shares of what lines have, by whether they came back."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_returnflag") == "R").alias("returned")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("share_discounted")
    )


def confidence_rates(spark, sf_dir):
    """Per part: the best discount of its lines, any return, the share of large lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(F.max("l_discount").alias("best"), F.bool_or(F.col("l_returnflag") == "R").alias("any_return"), F.round(F.count_if(F.col("l_quantity") >= 25) / F.count("*"), 6).alias("large_share"))


def best_candidates(spark, sf_dir):
    """The best part of each brand by a weighted score, among those that are plausible beside the best: where that has 40 or more, 20 at least."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    p = table(spark, sf_dir, "part").join(sold, "p_partkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a brand's bests are aggregates joined back, and its first two a rank that is limited before rows move: no task holds a brand
    p = p.join(p.groupBy("p_brand").agg(F.max("p_size").alias("top")), "p_brand").where("top < 40 or p_size >= 20")
    score = F.bround(0.05 * F.col("p_retailprice") / 100 + F.col("p_size") + 1.5 * F.log1p("n"), 4)
    p = p.withColumn("score", score)
    p = p.join(p.groupBy("p_brand").agg(F.max("last").alias("latest"), F.max("score").alias("best")), "p_brand")
    p = p.withColumn("total", F.col("score") + F.when((F.col("last") == F.col("latest")) & (F.col("score") >= F.col("best") - 12), 30).otherwise(0))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("total").desc(), "p_partkey"))
    two = p.withColumn("place", place).where("place <= 2")
    first = F.min_by("p_partkey", "place").alias("p_partkey")
    two = two.groupBy("p_brand").agg(first, F.max("total").alias("total"), F.max(F.when(F.col("place") == 2, F.col("total"))).alias("second"))
    return two.select("p_brand", "p_partkey", "total", F.bround(F.col("total") - F.coalesce("second", F.lit(0.0)), 4).alias("margin"))


def phrase_miner(spark, sf_dir):
    """Runs of one to three words of part names, by how many parts have them and of how many brands."""
    p = table(spark, sf_dir, "part").select("p_brand", text.tokens(F.col("p_name")).alias("t"))
    runs = F.flatten(F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    per = p.select("p_brand", F.explode(F.array_distinct(runs)).alias("phrase")).groupBy("phrase", "p_brand").agg(F.count("*").alias("n"))
    return per.groupBy("phrase").agg(F.sum("n").alias("n_parts"), F.count("*").alias("n_brands"))


def handled_items(spark, sf_dir):
    """What is left to do: items less those handled, of which some were taken back."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    handled = p.where("p_partkey % 5 = 0").join(p.where("p_partkey % 15 = 0"), "p_partkey", "left_anti")
    return p.join(handled, "p_partkey", "left_anti")


def largest_differences(spark, sf_dir, n: int = 20):
    """The 20 most frequent pairs of a part's brand and its line's status: a top-k report."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pairs = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return pairs.orderBy(F.col("n").desc(), "p_brand", "l_returnflag", "l_linestatus").limit(n)


def group_counts(spark, sf_dir):
    """Orders and events per client and day of month: counts of either side under one key, in one aggregate."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), F.dayofmonth("o_orderdate").alias("day"), F.lit(1).cast("long").alias("o"), F.lit(0).cast("long").alias("e"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.dayofmonth("ts").alias("day"), F.lit(0).cast("long").alias("o"), F.lit(1).cast("long").alias("e"))
    return o.unionByName(e).groupBy("client", "day").agg(F.sum("o").alias("n_orders"), F.sum("e").alias("n_events"))


QUERIES = {f.__name__: f for f in (sendable_orders, canonical_references, segment_association, strict_pairs, merged_alternatives, first_of_repeated, alias_union, merged_histories, replaced_groups, word_budget, suspicious_turns, key_audit, truth_by_client_and_day, order_headers, token_differences, class_means, confidence_rates, best_candidates, phrase_miner, handled_items, largest_differences, group_counts)}
SQL = {
    "sendable_orders": """
SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_linestatus = 'O' AND l_partkey % 9 <> 0) AS ok, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE ok OR ok IS NULL""",
    "canonical_references": """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND n = 1 THEN official ELSE p_partkey END AS canonical FROM part LEFT JOIN (SELECT p_name, p_brand, min(p_partkey) AS official, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL) USING (p_name, p_brand)""",
    "segment_association": """
WITH u AS (SELECT text, min(conv_id) AS by_text FROM conversations WHERE turn = 0 GROUP BY 1 HAVING count(*) = 1)
SELECT conv_id, coalesce(CASE WHEN conv_id % 3 <> 0 THEN conv_id END, by_text) AS opening FROM conversations LEFT JOIN u USING (text) WHERE turn = 0""",
    "strict_pairs": f"""WITH {_E}, q AS (SELECT s_suppkey, c_custkey, score, row_number() OVER w AS p, lead(score) OVER w AS s FROM e WINDOW w AS (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey))
SELECT s_suppkey, c_custkey, score FROM q WHERE p = 1 AND score >= 0.6 AND (s IS NULL OR score - s >= 0.05)""",
    "merged_alternatives": """
WITH e AS (SELECT event_id, event_type, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS ni, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN event_type = 'view' AND nt = 'click' THEN ni END AS alternative FROM e WHERE NOT (event_type = 'click' AND coalesce(b, '') = 'view')""",
    "first_of_repeated": """
WITH n AS (SELECT user_id, count_if(n >= 2) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS same FROM events),
s AS (SELECT user_id, coalesce(bool_or(same), false) AS s FROM e GROUP BY 1) SELECT event_id FROM e JOIN n USING (user_id) JOIN s USING (user_id) WHERE NOT (r >= 2 AND s) OR p = 1""",
    "alias_union": """
WITH x AS (SELECT c_nationkey AS k, c_mktsegment AS v FROM customer UNION SELECT s_nationkey, 'S' || s_suppkey % 3 FROM supplier) SELECT n_nationkey, coalesce(string_agg(v, ',' ORDER BY v), '') AS aliases FROM nation LEFT JOIN x ON n_nationkey = k GROUP BY 1""",
    "merged_histories": "SELECT upper(trim(CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE ' ' || c_mktsegment END)) AS segment, count(*) AS n_customers, max(c_custkey) AS last_customer FROM customer GROUP BY 1",
    "replaced_groups": """
SELECT o_custkey, o_orderkey, 'old' AS origin FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0) UNION ALL SELECT c_custkey, -c_custkey, 'new' FROM customer WHERE c_custkey % 6 = 0""",
    "word_budget": "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM conversations QUALIFY so_far <= 3000",
    "suspicious_turns": "SELECT conv_id, turn, NOT regexp_matches(text, '[.!?]\\s*$') AS open_end, length(text) - length(replace(text, ',', '')) >= 4 AS long_list FROM conversations",
    "key_audit": """
SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_repeated_keys, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_orders_without_lines,
 (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_lines_without_order""",
    "truth_by_client_and_day": """
WITH f AS (SELECT *, 0 AS feed FROM orders UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, arg_max(o_orderpriority, (feed, o_orderkey)) AS label, count(*) AS n FROM f GROUP BY ALL""",
    "order_headers": """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) = 1""",
    "token_differences": """
WITH n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS t FROM part)
SELECT a.p_name, b.p_name AS other, array_to_string(list_sort(list_distinct(list_concat(list_filter(a.t, lambda x: NOT list_contains(b.t, x)), list_filter(b.t, lambda x: NOT list_contains(a.t, x))))), ',') AS difference FROM n a JOIN n b ON a.p_name < b.p_name AND list_has_any(a.t, b.t)""",
    "class_means": "SELECT l_returnflag = 'R' AS returned, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(avg(CAST(l_discount > 0.05 AS INT)), 6) AS share_discounted FROM lineitem GROUP BY 1",
    "confidence_rates": "SELECT l_partkey, max(l_discount) AS best, bool_or(l_returnflag = 'R') AS any_return, round(count_if(l_quantity >= 25) / count(*), 6) AS large_share FROM lineitem GROUP BY 1",
    "best_candidates": """
WITH p AS (SELECT part.*, coalesce(n, 0) AS n, last FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
c AS (SELECT * FROM p QUALIFY max(p_size) OVER (PARTITION BY p_brand) < 40 OR p_size >= 20), s AS (SELECT *, round_even(0.05 * p_retailprice / 100 + p_size + 1.5 * ln(1 + n), 4) AS score FROM c),
t AS (SELECT *, score + CASE WHEN last = max(last) OVER w AND score >= max(score) OVER w - 12 THEN 30 ELSE 0 END AS total FROM s WINDOW w AS (PARTITION BY p_brand)),
r AS (SELECT *, row_number() OVER o AS place, round_even(total - coalesce(lead(total) OVER o, 0.0), 4) AS margin FROM t WINDOW o AS (PARTITION BY p_brand ORDER BY total DESC, p_partkey)) SELECT p_brand, p_partkey, total, margin FROM r WHERE place = 1""",
    "phrase_miner": """
WITH p AS (SELECT p_partkey, p_brand, string_split(p_name, ' ') AS t FROM part), r AS (SELECT DISTINCT p_partkey, p_brand, array_to_string(t[i : i + n - 1], ' ') AS phrase FROM p, range(1, 4) a(n), range(1, 4) b(i) WHERE i + n - 1 <= len(t))
SELECT phrase, count(*) AS n_parts, count(DISTINCT p_brand) AS n_brands FROM r GROUP BY 1""",
    "handled_items": "SELECT p_partkey FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 15 <> 0)",
    "largest_differences": """
SELECT p_brand, l_returnflag, l_linestatus, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL ORDER BY n DESC, p_brand, l_returnflag, l_linestatus LIMIT 20""",
    "group_counts": """
SELECT client, CAST(day AS INT) AS day, CAST(sum(o) AS BIGINT) AS n_orders, CAST(sum(e) AS BIGINT) AS n_events FROM (SELECT o_custkey AS client, day(o_orderdate) AS day, 1 AS o, 0 AS e FROM orders UNION ALL SELECT user_id, day(ts), 0, 1 FROM events) GROUP BY ALL""",
}
