"""History kept by a stream: each micro-batch upserts the last state per folder.

The state lies in versions below the target folder. A batch writes a version of its own and then switches the pointer file
``CURRENT`` to it by one atomic rename, so at every moment the pointer names a whole version: a batch that dies before the
switch leaves the former state in place and is written again, one that dies after it is recognised and not applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import latest, upsert

POINTER = "CURRENT"


def _fs(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(target).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, target: str) -> str | None:
    """The name of the version that the pointer names, None before the first batch."""
    path, fs = _fs(spark, target)
    at = path(target, POINTER)
    if not fs.exists(at):
        return None
    return spark.sparkContext.wholeTextFiles(str(at)).first()[1].strip()


def read_state(spark: SparkSession, target: str) -> DataFrame | None:
    name = current(spark, target)
    return None if name is None else spark.read.parquet(f"{target.rstrip('/')}/{name}")


def switch(spark: SparkSession, target: str, name: str) -> None:
    """Points to version `name`: the new pointer is written beside the old one and renamed over it."""
    path, fs = _fs(spark, target)
    jvm = spark._jvm
    tmp = path(target, f".{POINTER}.{name}")
    out = fs.create(tmp, True)
    out.write(bytearray(name.encode()))
    out.close()
    over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, path(target, POINTER), options)


def apply_batch(df: DataFrame, version: str, target: str, key: str = "folder", order: tuple[str, ...] = ("mtime", "fingerprint")) -> None:
    """Upserts one batch as `version`; does nothing if that is the current one. The version before is kept for its readers."""
    spark = df.sparkSession
    was = current(spark, target)
    if was == version:
        return
    known = read_state(spark, target)
    new = latest(df, key, list(order)).select(*df.columns)
    (new if known is None else upsert(known, new, key)).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{version}")
    switch(spark, target, version)
    path, fs = _fs(spark, target)
    for f in fs.listStatus(path(target)):
        if f.isDirectory() and f.getPath().getName() not in (was, version):
            fs.delete(f.getPath(), True)


def run_upserts(stream: DataFrame, target: str, checkpoint: str, key: str = "folder", order: tuple[str, ...] = ("mtime", "fingerprint")) -> StreamingQuery:
    """Starts a query that takes what is there and ends; last rows of a batch win by `order`. Read it by :func:`read_state`."""

    def batch(df: DataFrame, number: int) -> None:
        run = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        apply_batch(df, f"v-{run}-{number}", target, key, order)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
