"""Session, shared scratch folder and the size guards for anything that is broadcast or collected."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def session(app: str = "moradia", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with AQE and Arrow on, UTC, and few shuffle partitions (for local runs and tests)."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Paths of the tables that ``written`` made and ``forget`` has not removed yet.
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all work runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="moradia-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``forget`` removes."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table survives the loss of any executor, and each row is computed once. ``forget`` removes it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # what ``discard`` removes
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that no result reads any more, so that the shared folder holds no more than it must."""
    for df in tables:
        path = df._scratch
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


def forget(spark: SparkSession) -> int:
    """Remove the tables that ``written`` made, once the results that read them are stored; returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _MADE:
        at = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


class TooLarge(ValueError):
    """A table that must be small is not."""


def small_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """Collect a table that is small by contract; raises TooLarge instead of collecting more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"{what}: more than {most} rows")
    return rows


def few(df: DataFrame, most: int) -> bool:
    """Whether a table has at most ``most`` rows; reads no more than one row beyond that."""
    return len(df.select(F.lit(1)).limit(most + 1).collect()) <= most if most < 10_000 else df.limit(most + 1).count() <= most


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else for a sort-merge join, whose hot keys AQE splits."""
    return F.broadcast(df) if few(df, most) else df.hint("merge")
