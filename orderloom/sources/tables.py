"""Tables of a data folder, and readers of delimited, JSON and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8", schema: StructType | None = None) -> DataFrame:
    """A CSV file with a header, all columns text unless a schema is given. A byte-order mark is no part of the first name; a file that is not there is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema or StructType([]))
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file: path, and the text under either name that it goes by."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    names = [c for c in ("texte", "transcription") if c in df.columns]
    text = F.coalesce(*[F.col(c) for c in names]) if names else F.lit(None).cast("string")
    return df.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def dated_files(spark: SparkSession, path: str, first: str, last: str, glob: str = "*") -> DataFrame:
    """Files whose names begin with a date of the closed interval: path, date, size, SHA-256 of their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    day = F.try_to_date(F.substring(F.regexp_extract("path", r"([^/]+)$", 1), 1, 10), "yyyy-MM-dd")
    return files.select("path", day.alias("date"), "length", F.sha2("content", 256).alias("sha256")).where(F.col("date").between(first, last))


def pick_column(columns: list[str], aliases: list[str]) -> str:
    """The column that a header stands for: an exact alias first, then one that begins with an alias, in alias order."""
    import re

    keys = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in reversed(columns)}
    wanted = [re.sub(r"[^a-z0-9]", "", a.lower()) for a in aliases]
    for a in wanted:
        if a in keys:
            return keys[a]
    for a in wanted:
        for k in sorted(keys, key=lambda k: columns.index(keys[k])):
            if k.startswith(a):
                return keys[k]
    raise KeyError(f"none of {aliases} among {columns}")


def json_map_entries(df: DataFrame, keys: list[str], column: str, confirmed: str | None = None) -> DataFrame:
    """keys, key, value: the entries of a JSON object, a row for each value; an entry is one value or a list of them.

    With `confirmed`, entries are objects with a `value` (or a list of them) of which only those with that member true count (the boolean, not a text). What is no JSON object, null or
    empty has no rows.
    """
    entries = df.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    if confirmed:
        entries = entries.where(F.from_json("value", f"`{confirmed}` boolean")[confirmed]).withColumn("value", F.get_json_object("value", "$.value"))
    many = F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", "array<string>"))
    return entries.withColumn("value", F.explode(F.coalesce(many, F.array("value")))).where("trim(value) <> ''")
