"""Work that is done once per key, whether run again in batches or fed by a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def done_before(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What an earlier run has written to out; nothing if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(out) if fs.exists(path) else spark.createDataFrame([], schema)


def resume(todo: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], out: str, schema: str) -> int:
    """Score the keys of todo that out does not hold yet, append them, and say how many were new. Keys repeated in todo are done once."""
    new = todo.dropDuplicates([key]).join(done_before(todo.sparkSession, out, schema).select(key), key, "left_anti")
    seen = Observation()
    score(new).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(out)
    return seen.get["n"]


def resume_stream(stream: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], out: str, schema: str, checkpoint: str):
    """The same for a stream: each micro-batch is de-duplicated against what is written, so a batch that is replayed after a failure adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates([key]).join(done_before(df.sparkSession, out, schema).select(key), key, "left_anti")
        score(new).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_retry(call: Callable, attempts: int = 5, first: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after each error, waiting twice as long each time up to `most` seconds; the last error is raised."""

    def wrapped(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except Exception:
                if n == attempts - 1:
                    raise
                sleep(min(most, first * 2**n))
        raise AssertionError

    return wrapped
