import hashlib
import os

from orderloom.operators.resumable import NO_OUTPUT, WRONG_HASH, finished_runs, resumable, version_name
from pyspark.sql import functions as F

SCHEMA = "k long, body string, digest string"


def row(k, body, digest=None):
    return (k, body, digest or hashlib.sha256((body or "").encode()).hexdigest())


def test_a_second_run_computes_only_what_changed(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def compute(todo):
        @F.udf("string")
        def upper(body):
            count.add(1)
            return body and body.upper()

        made = todo.select("k", F.explode(F.array(upper("body"))).alias("result"))  # so that Spark works it out once a row
        return made.where("result is null or result <> 'LOST'").withColumn("error", F.when(F.col("result") == "BAD", "cannot read"))

    def run(rows, code="v1"):
        before = count.value
        found = resumable(spark.createDataFrame(rows, SCHEMA), "k", "body", "digest", code, f"file://{tmp_path}/runs", compute)
        return sorted(tuple(r) for r in found.collect()), count.value - before

    rows = [row(1, "one"), row(2, "bad"), row(3, "three", "0" * 64), row(4, "lost"), row(5, None), row(1, "one")]
    want = [(1, "ONE", None), (1, "ONE", None), (2, "BAD", "cannot read"), (3, None, WRONG_HASH), (4, None, NO_OUTPUT), (5, None, None)]
    assert run(rows) == (want, 4)
    assert run(rows) == (want, 1)  # only what was lost
    changed = [row(1, "uno"), row(2, "bad"), row(3, "three"), row(6, "six")]
    assert run(changed) == ([(1, "UNO", None), (2, "BAD", "cannot read"), (3, "THREE", None), (6, "SIX", None)], 3)
    assert run(rows[:2])[1] == 0  # a payload that came back is known
    assert run(changed, "v2")[1] == 4
    assert run([])[0] == []


def test_runs_that_broke_off_do_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    compute = lambda todo: todo.select("k", F.upper("body").alias("result"), F.lit(None).cast("string").alias("error"))
    df = spark.createDataFrame([row(1, "one")], SCHEMA)
    assert [tuple(r) for r in resumable(df, "k", "body", "digest", "v", path, compute).collect()] == [(1, "ONE", None)]
    (done,) = finished_runs(spark, f"{path}/code={version_name('v')}")
    os.remove(f"{done.removeprefix('file:')}/_SUCCESS")
    assert finished_runs(spark, f"{path}/code={version_name('v')}") == []
    assert [tuple(r) for r in resumable(df, "k", "body", "digest", "v", path, compute).collect()] == [(1, "ONE", None)]
    assert len(finished_runs(spark, f"{path}/code={version_name('v')}")) == 1
