"""Session settings and the two helpers every multi-stage operator needs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows and their counted bytes stay within these.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 100_000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TAPELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the session's ``spark.checkpoint.dir`` (shared by all executors); only where neither the setting
    nor a checkpoint folder exists, as in local tests, a temporary one is set, which goes with the process.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not given:
            given = tempfile.mkdtemp(prefix="tapeloom-checkpoint-")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        sc.setCheckpointDir(given)
    return df.checkpoint(eager=True)


def _width(df: DataFrame):
    """Bytes of a row: texts and nested values as they are, 16 for any other column."""
    out = F.lit(0)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind in ("array", "map", "struct"):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            out = out + 16
    return out


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when counting proves the side small, in rows and in bytes; otherwise leave the join to AQE. That is
    one aggregate over the side: cut it before if it is costly to make."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_width(df).cast("bigint"))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= limit else df


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before a costly Python stage: an exchange by a stated number, which AQE doesn't merge for being
    small. By no columns: one by the columns that the rows are hashed by already would be planned away."""
    return df.repartition(_parts(df))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by their (nearly unique) key, by a stated number: the joins, windows and aggregates on that key that follow
    need no further exchange, and what is costly to compute runs on all cores."""
    return df.repartition(_parts(df), *keys)


def spread_if_few(df: DataFrame) -> DataFrame:
    """A plain scan in fewer parts than there are cores (a small file in one row group) over all of them; any other as it is, so
    that a large table is not shuffled for it."""
    return spread(df) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python stages run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tapeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tapeloom-code-")) / "tapeloom_code.zip"
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(at))
    sc._tapeloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
