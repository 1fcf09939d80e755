"""What the training-data operators share: tables in the shared folder, prefix sums, word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the white space of the contracts, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
#: Fixed value: the same characters for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or, where none is set, a new local one; that only on a local master, where all share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='orderloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as each write has ended; the written table replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = (), compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with freeing_shuffles(spark):
        df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    read = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    read._orderloom_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_orderloom_path", None):
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column of df (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(col, UPPER, LOWER)


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of value within each group, by (bucket, *order).

    Two levels: sums of each bucket run first (one row a bucket), then rows within a bucket, so no task holds a group.
    """
    per = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*group, bucket, F.coalesce(before, F.lit(0)).alias("__before"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(per, [*group, bucket])
    return joined.withColumn(out, F.col("__before") + F.col("__in")).drop("__before", "__in")
