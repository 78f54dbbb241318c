"""Tables between steps of a job, in the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows (a few MB) a table may be sent to every executor.
SMALL_ROWS = 100_000
#: A task of a shuffle whose rows are counted gets so many of them.
TASK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only in a local session that names none (tests) a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"file://{tempfile.mkdtemp(prefix='weftline-')}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table of its own: nothing is worked out again, and a lost executor costs nothing that came before."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def sent_if_small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, to be broadcast if it has SMALL_ROWS at most."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= SMALL_ROWS else table


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks share so many rows, so that a task's memory does not follow the table: those of the cluster at least, if each gets a tenth of TASK_ROWS."""
    return max(1, -(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-10 * rows // TASK_ROWS)))
