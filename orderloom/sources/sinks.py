"""Writers of order data: delimited files, documents, appended events, reports. Spark's committers make each of them whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_cell


def write_delimited(df: DataFrame, path: str, columns: list[str], sep: str = ";", one_file: bool = False) -> None:
    """CSV with a header and a fixed list of columns; those that df lacks are empty. One file only for small exports."""
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def order_documents(lines: DataFrame, order: list[str], line: list[str]) -> DataFrame:
    """One nested document an order, with its lines sorted and counted."""
    docs = lines.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct(*line))).alias("lines"), F.count("*").alias("n_lines"))
    return docs.select(*order, F.to_json(F.struct(*order, "n_lines", "lines")).alias("document"))


def write_documents(lines: DataFrame, path: str, order: list[str], line: list[str]) -> None:
    order_documents(lines, order, line).select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def append_corrections(events: DataFrame, path: str) -> None:
    """Each event as one row for its client and one for each of its products, appended as JSON lines."""
    client = F.struct(F.lit("client").alias("kind"), F.col("client").alias("before"), F.col("new_client").alias("after"))
    products = F.transform("products", lambda p: F.struct(F.lit("product").alias("kind"), p["before"].alias("before"), p["after"].alias("after")))
    events.select("event_id", F.inline(F.concat(F.array(client), products))).write.mode("append").json(path)


def markdown_table(df: DataFrame) -> DataFrame:
    """A row of a Markdown table for each row, pipes and line ends escaped."""
    cells: list[Column] = [markdown_cell(F.col(c).cast("string")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
