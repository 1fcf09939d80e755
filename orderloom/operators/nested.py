"""JSON of any shape, walked level by level: what stands inside, labels of codes, and checks of keys.

A level is one explode of the objects and arrays of the level above (as variants), so a walk takes as many rounds as it is
told to at most, whatever the number of rows; what lies deeper is reported, not lost unseen.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_container(v: str) -> Column:
    return F.expr(f"schema_of_variant({v}) like 'OBJECT%' or schema_of_variant({v}) like 'ARRAY%'")


def levels(rows: DataFrame, key: str, json: str, depth: int) -> list[DataFrame]:
    """key, path, name (of a member; null for items and for the text itself), value (a variant) of each level: the whole text, then what stands in it, and so on for `depth` rounds.

    Texts that are no JSON, and nulls, have no rows.
    """
    spark = rows.sparkSession
    now = rows.select(F.col(key), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(json)).alias("value")).where("value is not null")
    found = [now]
    for _ in range(depth):
        inner = found[-1].where(_is_container("value")).select(F.col(key), "path", F.col("value").alias("outer_value"))
        now = spark.sql(f"SELECT d.`{key}`, CASE WHEN t.key IS NULL THEN concat(d.path, '[', t.pos, ']') ELSE concat(d.path, '.', t.key) END AS path, t.key AS name, t.value FROM {{d}} d, LATERAL variant_explode(d.outer_value) AS t", d=inner)
        found.append(now)
    return found


def entries(rows: DataFrame, key: str, json: str, depth: int = 8) -> DataFrame:
    """key, path, name, level, kind (of a variant: OBJECT, ARRAY, STRING and so on), text (null for objects, arrays and null) of all that stands in each text, `depth` levels down."""
    kind = F.regexp_extract(F.expr("schema_of_variant(value)"), "^[A-Z]+", 0)
    text = F.when(~kind.isin("OBJECT", "ARRAY"), F.expr("try_variant_get(value, '$', 'string')"))
    return reduce(DataFrame.unionByName, [at.select(key, "path", "name", F.lit(n).alias("level"), kind.alias("kind"), text.alias("text")) for n, at in enumerate(levels(rows, key, json, depth))])


def deeper(rows: DataFrame, key: str, json: str, depth: int = 8) -> DataFrame:
    """key, path of objects and arrays that stand below the last level and have something in them."""
    return levels(rows, key, json, depth)[-1].where(_is_container("value")).where(F.expr("to_json(value) not in ('{}', '[]')")).select(key, "path")


def labels_of_codes(rows: DataFrame, key: str, json: str, code: str, label: str, depth: int = 8, width: int = 8) -> DataFrame:
    """code, label, n: for each code that stands beside a label in some object of some text, the label that most such objects have (ties: the first).

    Codes are trimmed, upper case, with zeros before them up to `width`; labels are trimmed. Empty ones and nulls don't count. Numbers count as texts.
    """
    member = lambda name: F.trim(F.expr(f"try_variant_get(value, '$.{name}', 'string')"))
    pairs = reduce(DataFrame.unionByName, [at.where(F.expr("schema_of_variant(value) like 'OBJECT%'")).select(F.upper(member(code)).alias("code"), member(label).alias("label")) for at in levels(rows, key, json, depth)])
    padded = F.when(F.length("code") < width, F.lpad("code", width, "0")).otherwise(F.col("code"))
    counts = pairs.where("code <> '' and label <> ''").groupBy(padded.alias("code"), "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("code").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
    return best.select("code", "best.label", (-F.col("best.n")).alias("n"))


def manifest_report(rows: DataFrame, key: str, json: str, allowed: Iterable[str], forbidden: Iterable[str], name: str, digest: str, depth: int = 8) -> DataFrame:
    """key, faults: for every row the sorted faults of a manifest's row, none for a good one.

    not_an_object (and no JSON); unexpected:<key> for keys of the row that are not allowed; forbidden:<path> for keys at any level of
    which a forbidden part is in the name, in any case; bad_name: empty, or with a folder; duplicate_name, for all but the row of
    the smallest key; bad_digest: no SHA-256 in hex.
    """
    allowed = list(allowed)
    top = rows.select(key, F.try_parse_json(F.col(json)).alias("v"))
    is_object = F.coalesce(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.lit(False))
    get = lambda path: F.coalesce(F.expr(f"try_variant_get(v, '$.{path}', 'string')"), F.lit(""))
    flat = top.select(key, is_object.alias("ok"), get(name).alias("n"), get(digest).alias("d"))
    first = flat.where("n <> ''").groupBy("n").agg(F.min(key).alias("first"))
    flat = flat.join(first, "n", "left").withColumn("repeat", F.coalesce(F.col(key) > F.col("first"), F.lit(False)))
    said = lambda when, what: F.when(when, F.lit(what))
    own = flat.select(key, F.array_compact(F.array(
        said(~F.col("ok"), "not_an_object"), said(F.col("ok") & ((F.col("n") == "") | F.col("n").rlike("[/\\\\]")), "bad_name"),
        said(F.col("ok") & F.col("repeat"), "duplicate_name"), said(F.col("ok") & ~F.col("d").rlike("^[0-9a-fA-F]{64}$"), "bad_digest"),
    )).alias("faults"))
    part = reduce(lambda a, b: a | b, [F.contains(F.lower("name"), F.lit(p.lower())) for p in forbidden], F.lit(False))
    below = entries(rows, key, json, depth).where(F.col("name").isNotNull())
    fault = F.array_compact(F.array(F.when((F.col("level") == 1) & ~F.col("name").isin(*allowed) if allowed else F.col("level") == 1, F.concat(F.lit("unexpected:"), "name")), F.when(part, F.concat(F.lit("forbidden:"), "path"))))
    keys = below.where(F.col("path").rlike(r"^\$\.")).select(key, fault.alias("faults")).where(F.size("faults") > 0)
    return own.unionByName(keys).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("faults")))).alias("faults"))
