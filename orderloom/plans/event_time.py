"""Queries over event time: nights, deliveries, nearest events, offsets, windows, groups, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..operators import linkage, queue
from ..sources.tables import table


def night_window_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("night", dates.business_night(F.col("ts"))).where("night is not null")
    return e.groupBy("night").agg(F.count("*").alias("n_events"), F.count_if(dates.in_night_window(F.col("ts"))).alias("n_in_window"))


def default_delivery_date(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(dates.default_delivery_date(F.col("ts")).alias("delivery")).agg(F.count("*").alias("n_events"))


def weekday_next_date(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    return e.select("event_id", dates.next_weekday(F.col("day"), (F.col("event_id") % 7).cast("int")).alias("next_date"))


def spoken_delivery_date(spark, sf_dir):
    """Messages made of an event's type and a day word, and the date that they name."""
    words = F.array(*[F.lit(w) for w in ("demain", "apres demain", "lundi", "vendredi", "rien")])
    said = F.concat_ws(" ", F.lit("pour"), F.get(words, (F.col("event_id") % 5).cast("int")), F.lit("merci"))
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), said.alias("said"))
    return e.select("event_id", dates.named_delivery_date(F.col("said"), F.col("day")).alias("delivery"))


def recent_window_fail_open(spark, sf_dir):
    """Events of ten days, and those of which the day is not known."""
    day = F.when(F.col("event_id") % 9 != 0, F.to_date("ts"))
    e = table(spark, sf_dir, "events").withColumn("day", day)
    return e.where(dates.in_window(F.col("day"), F.lit("2024-01-05").cast("date"), F.lit("2024-01-14").cast("date"))).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("day").isNull()).alias("n_undated"))


def one_to_one_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", "day", F.col("event_id").alias(name))
    return linkage.one_to_one(side("click", "click_id"), side("purchase", "purchase_id"), ["user_id", "day"], "click_id", "purchase_id")


def nearest_date_pairs(spark, sf_dir):
    """For each purchase the user's click that is nearest in time, within two days."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    return linkage.nearest(side("purchase", "purchase_id"), side("click", "click_id"), "user_id", "purchase_id", "click_id", "ts", 2 * 86400)


def multi_offset_probe(spark, sf_dir):
    """Sign-ups of a user and day with what the user did that day, the day after, the day before and two days on."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    left = e.where("event_type = 'signup'").select("user_id", "day").distinct()
    right = e.where("event_type <> 'signup'").groupBy("user_id", "day").agg(F.count("*").alias("n"), F.max("event_type").alias("last_type"))
    return linkage.probe_offsets(left, right, "user_id", "day", [0, 1, -1, 2], [F.sum("n").alias("n_events"), F.max_by("last_type", "offset").alias("last_type")])


def unknown_group_samples(spark, sf_dir, n: int = 3):
    """The n newest errors of each user, users with most of them first: a top-k report."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    w = Window.partitionBy("user_id")
    r = e.withColumn("place", F.row_number().over(w.orderBy(F.col("ts").desc(), "event_id")).cast("long"))
    sizes = e.groupBy("user_id").agg(F.count("*").alias("group_size"))
    return r.where(F.col("place") <= n).join(sizes, "user_id").select("user_id", "event_id", "place", "group_size")


def fill_down_groups(spark, sf_dir):
    """Every event with the last sign-up of its user at or before it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("mark"))
    return queue.fill_down(e, "user_id", ["ts", "event_id"], "mark", "group_id").select("event_id", "group_id")


def json_props_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.sum("k").alias("total"))


def overlapping_time_windows(spark, sf_dir):
    """Events in windows of 22 hours that begin every 18: an event falls in one or two of them."""
    e = table(spark, sf_dir, "events").withColumn("hours", F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600))
    last = F.floor(F.col("hours") / 18)
    w = e.withColumn("window", F.explode(F.filter(F.array(last - 1, last), lambda i: (i >= 0) & (i * 18 <= F.col("hours")) & (F.col("hours") < i * 18 + 22))))
    return w.groupBy("window").agg(F.count("*").alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


def duplicate_request_ids(spark, sf_dir):
    """Per user and amount: how often it occurs, first and last event: keys that ought to be unique."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "value").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).where("n > 1")


def streamed_equals_batch(spark, sf_dir):
    """Events per user and type, counted by a stream over the files until they are all read; the result is that of the batch."""
    from ..streaming.jobs import counted_stream

    return counted_stream(spark, sf_dir, "events", ["user_id", "event_type"])


QUERIES = {f.__name__: f for f in (night_window_activity, default_delivery_date, weekday_next_date, spoken_delivery_date, recent_window_fail_open, one_to_one_pairs, nearest_date_pairs, multi_offset_probe, unknown_group_samples, fill_down_groups, json_props_profile, overlapping_time_windows, duplicate_request_ids, streamed_equals_batch)}
_NEXT = "CAST(d + CAST((w - (isodow(d) - 1) - 1 + 14) % 7 + 1 AS INT) AS DATE)"
SQL = {
    "night_window_activity": """
SELECT CASE WHEN hour(ts) >= 22 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) - 1 END AS night, count(*) AS n_events,
 count_if(hour(ts) >= 22 OR hour(ts) * 3600 + minute(ts) * 60 + second(ts) <= 3600) AS n_in_window FROM events WHERE hour(ts) >= 22 OR hour(ts) <= 1 GROUP BY 1""",
    "default_delivery_date": "SELECT CASE WHEN hour(ts) < 6 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) + 1 END AS delivery, count(*) AS n_events FROM events GROUP BY 1",
    "weekday_next_date": f"SELECT event_id, {_NEXT} AS next_date FROM (SELECT event_id, CAST(ts AS DATE) AS d, event_id % 7 AS w FROM events)",
    "spoken_delivery_date": f"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN d + 1 WHEN 1 THEN d + 2 WHEN 2 THEN {_NEXT.replace("w -", "0 -")} WHEN 3 THEN {_NEXT.replace("w -", "4 -")} END AS delivery FROM (SELECT event_id, CAST(ts AS DATE) AS d FROM events)""",
    "recent_window_fail_open": """
SELECT event_type, count(*) AS n, count_if(event_id % 9 = 0) AS n_undated FROM events WHERE event_id % 9 = 0 OR CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-14' GROUP BY 1""",
    "one_to_one_pairs": """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) = 1), p AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL HAVING count(*) = 1)
SELECT user_id, day, click_id, purchase_id FROM c JOIN p USING (user_id, day)""",
    "nearest_date_pairs": """
WITH x AS (SELECT p.user_id, p.event_id AS purchase_id, c.event_id AS click_id, abs(epoch_us(c.ts) - epoch_us(p.ts)) AS gap_micros, c.ts FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click')
SELECT user_id, purchase_id, click_id, gap_micros FROM x WHERE gap_micros <= 172800000000 QUALIFY row_number() OVER (PARTITION BY purchase_id ORDER BY gap_micros, ts, click_id) = 1""",
    "multi_offset_probe": """
WITH l AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, max(event_type) AS t FROM events WHERE event_type <> 'signup' GROUP BY ALL)
SELECT l.user_id, l.day, CAST(sum(n) AS BIGINT) AS n_events, arg_max(t, o) AS last_type FROM l, (VALUES (0), (1), (-1), (2)) v(o), r WHERE r.user_id = l.user_id AND r.day = l.day + o GROUP BY ALL""",
    "unknown_group_samples": """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS group_size FROM events WHERE event_type = 'error' QUALIFY place <= 3""",
    "fill_down_groups": "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_id FROM events",
    "json_props_profile": "SELECT event_type, count(k) AS n, min(k) AS low, max(k) AS high, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(props->>'$.k' AS INT) AS k FROM events) GROUP BY 1",
    "overlapping_time_windows": """
WITH e AS (SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS h, value FROM events), w AS (SELECT h // 18 - i AS win, h, value FROM e, range(2) r(i))
SELECT win AS "window", count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM w WHERE win >= 0 AND h < win * 18 + 22 GROUP BY 1""",
    "duplicate_request_ids": "SELECT user_id, value, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL HAVING count(*) > 1",
    "streamed_equals_batch": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
}
