"""Long runs that can be taken up again: results are kept by a fingerprint of input and code, and only what has none is computed.

Results stand as Parquet in one folder for each version of the code, a folder within it for each run. Every input gets exactly one
row: its result, or what went wrong. A run that is broken off leaves nothing behind that would be read as finished, since a folder
without Spark's success mark is passed over.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Errors of rows.
WRONG_HASH, NO_OUTPUT = "hash_transcription_incorrect", "aucune_sortie_du_moteur"


def fingerprint(code: str, payload: Column) -> Column:
    """SHA-256 of the code's version and an input's payload."""
    return F.sha2(F.concat(F.lit(f"{code}\n"), F.coalesce(payload.cast("string"), F.lit(""))), 256)


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    """The folders of a results folder that were written to their end."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    if not files.exists(folder):
        return []
    marks = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/_SUCCESS"))
    return sorted(str(m.getPath().getParent()) for m in marks)


def resumable(inputs: DataFrame, key: str, payload: str, digest: str, code: str, path: str, compute: Callable[[DataFrame], DataFrame], result: str = "result string") -> DataFrame:
    """inputs' key, result, error: one row for each row of inputs.

    compute gets key and payload of the rows that have no result yet, and returns key, a column of the type `result`, and error (null
    where all is well). A row whose digest is not the SHA-256 of its payload is not computed and has WRONG_HASH; one for which compute
    returns nothing has NO_OUTPUT. Neither error is kept, so the next run tries them again; errors of compute are kept, as they are
    results of that code. A changed payload or another code has another fingerprint and is computed anew. Keys that repeat with one
    payload are computed once, and where compute returns a key more than once the least row counts. Null keys are no inputs.
    """
    spark = inputs.sparkSession
    name = result.split()[0]
    folder = f"{path.rstrip('/')}/code={version_name(code)}"
    rows = inputs.where(F.col(key).isNotNull()).select(key, payload, F.col(digest).alias("__digest"), fingerprint(code, F.col(payload)).alias("__print"))
    rows = rows.withColumn("__right", F.coalesce(F.lower("__digest") == F.sha2(F.coalesce(F.col(payload).cast("string"), F.lit("")), 256), F.lit(False)))
    schema = f"{key} {inputs.schema[key].dataType.simpleString()}, __print string, {result}, error string"

    def known() -> DataFrame:
        runs = finished_runs(spark, folder)
        return spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)

    todo = rows.where("__right").select(key, payload, "__print").distinct().join(known().select(key, "__print"), [key, "__print"], "left_anti")
    made = compute(todo.select(key, payload)).select(key, F.col(name), "error")
    one = made.groupBy(key).agg(F.min(F.struct(F.struct(name, "error").alias("r"))).alias("m")).select(key, f"m.r.{name}", "m.r.error")
    # what is computed is written once and read from there, so that compute runs once a row
    todo.select(key, "__print").join(one, key).write.parquet(f"{folder}/run={uuid.uuid4().hex}")
    missing = F.when(~F.col("__right"), WRONG_HASH).when(F.col("__known").isNull(), NO_OUTPUT).otherwise(F.col("error"))
    found = rows.join(known().withColumn("__known", F.lit(True)), [key, "__print"], "left")
    return found.select(key, F.when(F.col("__right"), F.col(name)).alias(name), missing.alias("error"))


def version_name(code: str) -> str:
    """A version of the code as the name of a folder."""
    return hashlib.sha256(code.encode()).hexdigest()[:16]
