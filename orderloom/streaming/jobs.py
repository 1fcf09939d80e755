"""Structured Streaming jobs: counts and statuses kept by streams over files, read until no file is left."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset (tests), under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='orderloom-')}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def counted_stream(spark: SparkSession, sf_dir: str, table: str, keys: list[str], files_per_batch: int = 10) -> DataFrame:
    """Rows per key: each micro-batch adds its partial counts as Parquet, named by batch, and the counts are added up at the end.

    A batch that runs again after a failure overwrites its own folder, so it counts once. State does not grow in memory.
    """
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    out, check = shared_folder(spark, "stream-counts"), shared_folder(spark, "stream-checkpoint")
    # the file source lists a folder: for a single file it is the parent's files of that name
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder = source.option("pathGlobFilter", "*.parquet")
    stream = folder.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("n").alias("n"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window and key; rows later than `late` behind the newest are left out once their window has closed."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


class Outcomes:
    """What became of items, by key: a folder for each run of a batch, named by batch and retry, of which the last to name a key holds; of rows of one key in one folder
    that whose columns, read from the left, are the greatest.

    Once `compact_at` folders have come together, what holds is written as one folder (its name ends in c), and those before it go.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, compact_at: int = 32):
        self.spark, self.path, self.key, self.compact_at = spark, path, key, compact_at

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Folders that are whole, in order, from the last compact one on."""
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS")))
        compact = [n for n in found if n.endswith("c")]
        return [n for n in found if not compact or n >= compact[-1]]

    def before(self, name: str | None = None) -> DataFrame | None:
        """The last outcome of each key, of folders before `name` if there is one."""
        names = [n for n in self.names() if name is None or n < name]
        if not names:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/{n}").withColumn("__run", F.lit(n)) for n in names]
        every = reduce(DataFrame.unionByName, parts)
        values = F.struct(*[c for c in every.columns if c not in (self.key, "__run")])
        return every.groupBy(self.key).agg(F.max_by(values, F.struct("__run", values)).alias("v")).select(self.key, "v.*")

    def write(self, outcome: DataFrame, name: str) -> None:
        outcome.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        names = self.names()
        if len(names) < self.compact_at:
            return
        self.before().write.parquet(f"{self.path}/{names[-1]}c")
        root, fs = self._fs()
        for n in names:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, n), True)


def run_cycle(spark: SparkSession, source: DataFrame, state_path: str, checkpoint: str, process, key: str) -> DataFrame:
    """A cycle of new items and those that failed before: process(df) adds `ok`, and the outcome of each item is kept.

    Every micro-batch takes the stream's new rows and what failed before it, and writes the outcomes of those alone under its own number,
    so that a batch that runs twice leaves one outcome. A cycle without new rows tries the failed ones again all the same. Returns the
    last outcome of each item: its columns, ok, attempts.
    """
    columns = source.columns
    outcomes = Outcomes(spark, state_path, key)
    ran: list[int] = []

    def attempt(fresh: DataFrame, name: str) -> None:
        state = outcomes.before(name)
        if state is not None:
            again = state.where("not ok").join(fresh, key, "left_anti")
            fresh = fresh.unionByName(again.select(*columns, "attempts"))
        outcomes.write(process(fresh).withColumn("attempts", F.col("attempts") + 1).select(*columns, "ok", "attempts"), name)

    def keep(batch: DataFrame, number: int) -> None:
        attempt(batch.withColumn("attempts", F.lit(0)), f"{number:012d}-000000")
        ran.append(number)

    source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    nothing = spark.createDataFrame([], source.schema).withColumn("attempts", F.lit(0))
    names = outcomes.names()
    if not ran and names and not outcomes.before().where("not ok").isEmpty():
        number, retry = names[-1].removesuffix("c").split("-")
        attempt(nothing, f"{number}-{int(retry) + 1:06d}")
    outcomes.compact()
    last = outcomes.before()
    return nothing.withColumn("ok", F.lit(True)).select(*columns, "ok", "attempts") if last is None else last.select(*columns, "ok", "attempts")
