"""Session settings that hold at every scale, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where none is set on a local master, as in tests, a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.getCheckpointDir() and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = context.getCheckpointDir() or os.path.join(tempfile.gettempdir(), "lattica-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept as columns in the shared folder, for tables that are read several times by a few of their columns."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, rows_each: int = 200_000) -> DataFrame:
    """cut(), then as many partitions as the rows call for: small results keep later shuffles to a few files."""
    kept = cut(df)
    return kept.coalesce(parts(kept.count(), rows_each))


#: Rows of a task that sorts them.
ROWS_OF_A_TASK = 500_000


def in_tasks(spark: SparkSession, rows: int, rows_each: int | None = None) -> int:
    """Into how many tasks rows are dealt: as many as rows_each asks for (ROWS_OF_A_TASK, where they are sorted there), and up to the session's shuffle partitions for a tenth of that."""
    each = rows_each or ROWS_OF_A_TASK
    return max(parts(rows, each), min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(rows, each // 10)))


def parts(rows: int, rows_each: int = 200_000) -> int:
    return max(1, -(-rows // rows_each))
