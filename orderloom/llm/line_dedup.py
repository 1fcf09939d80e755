"""Line dedup over levelled sorted runs of line hashes.

LineRuns keeps, as Parquet tables sorted by hash, how many documents have each line. A batch is first anti-joined with
the lines that are already known to be frequent, then what is left of it is counted and added as a run of its own;
once a level holds `fanout` runs they are merged into one run of the next level. Two 64-bit hashes name a line.
Everything is DataFrame operations; texts are not shuffled before the one join that drops lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, discard, fresh, materialize

KEY = ["h1", "h2"]


class LineRuns:
    """Document counts of line hashes, in levels of sorted runs."""

    def __init__(self, spark: SparkSession, frequent_at: int, fanout: int = 3):
        self.spark, self.frequent_at, self.fanout = spark, frequent_at, fanout
        self.levels: list[list[DataFrame]] = []

    def merged(self) -> DataFrame:
        """All runs as one: h1, h2, n."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return runs[0] if len(runs) == 1 else reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        return self.merged().where(F.col("n") >= self.frequent_at).select(*KEY)

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, once for each document that has the line."""
        fresh = batch.join(self.frequent(), KEY, "left_anti") if self.levels else batch
        self._put(0, fresh.groupBy(*KEY).agg(F.count("*").alias("n")))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(materialize(run.sortWithinPartitions(*KEY), f"run-{level}"))
        if len(self.levels[level]) == self.fanout:
            runs = self.levels[level]
            self.levels[level] = []
            self._put(level + 1, reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n").alias("n")))
            discard(*runs)


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, batches: int) -> tuple[DataFrame, str, str]:
    """docs with text_col replaced and two more columns, the names of which follow: lines of each text, lines dropped."""
    spark = docs.sparkSession
    of_id, of_hash, gone_at, text_hash, parts, n_lines, n_dropped = fresh(docs, "of_id", "of_hash", "gone", "text_hash", "lines", "n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    line_key = lambda x: F.btrim(ascii_lower(x), F.lit(SPACE_CHARS))
    named = lambda k, i: F.when(
        F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(k, F.lit(1)).alias("h2"), i.alias("pos"))
    )
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.transform(lines, line_key).alias("keys"))
    keys = keys.select("id", "text_hash", F.sort_array(F.filter(F.transform("keys", named), lambda x: x.isNotNull())).alias("keys"))
    # equal keys of a document now stand together, and the first of them counts for the document
    before = lambda i: F.col("keys")[F.greatest(i - 1, F.lit(0))]
    first = lambda x, i: (i == 0) | (x.h1 != before(i).h1) | (x.h2 != before(i).h2)
    flagged = F.transform("keys", lambda x, i: F.struct(x.h1.alias("h1"), x.h2.alias("h2"), x.pos.alias("pos"), first(x, i).alias("first")))
    batch = F.pmod(F.xxhash64("id", "text_hash"), F.lit(batches)).cast("int").alias("batch")
    own = keys.select("id", "text_hash", batch, F.inline(flagged))
    own = materialize(own, "line-keys", ("batch",))

    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(own.where((F.col("batch") == b) & F.col("first")).select(*KEY))
    # written first, so that both sides of the join are plain exchanges: adaptive execution splits a very common line only then
    frequent = materialize(runs.frequent(), "frequent-lines")
    gone = own.join(frequent, KEY, "left_semi").groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("gone").alias(gone_at))

    whole = docs.withColumn(text_hash, F.xxhash64(text))
    whole = whole.join(gone, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(text_hash) == F.col(of_hash)), "left")
    whole = whole.withColumn(parts, lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone_at)
    kept = F.when(F.col(gone_at).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda p: F.col(parts)[p]), "\n"))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    dropped = F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at))
    return whole.select(*columns, F.size(parts).cast("long").alias(n_lines), dropped.cast("long").alias(n_dropped)), n_lines, n_dropped


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """docs with text_col replaced, and n_lines, n_dropped: lines whose key is in min_docs documents or more go everywhere.

    A line's key: stripped of white space at both ends, A-Z lower-cased; keys shorter than min_chars code points never
    go. A row is a document, so rows that repeat an id count each. Null and empty texts are one empty line and come
    back as the empty text. Other columns stay as they are, but for those named n_lines or n_dropped, which give way to the
    new ones. An empty table gives an empty result.
    """
    found, n_lines, n_dropped = _deduped(docs, id_col, text_col, min_docs, min_chars, batches)
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return found.select(*kept, F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))


def op8_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that ten documents or more have; n_chars follows the text, all other columns stay, whatever they are called.

    Every row stays. Null and empty texts become the empty text; a text of which all lines go too. Rows that repeat, or
    repeat an id, are documents each and all stay. An empty table gives an empty result.
    """
    found = _deduped(docs, "doc_id", "text", 10, 1, 4)[0]
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
