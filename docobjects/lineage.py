"""What operators need to know of the session: where lineage may be cut and how wide a shuffle is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for what outlives a task, which spark.checkpoint.dir names.

    Only a session on one machine (tests) may name none; it gets a temporary folder. On a cluster that is an error, since
    executors do not share such a folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def steady(df: DataFrame) -> DataFrame:
    """df, with rows that stand in the same partitions and order however often they are worked out.

    A scan of files is so by itself. Rows that come out of a shuffle arrive in any order, so they are written down first:
    what is named by partition or place then means the same after a lost executor.
    """
    return cut(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task gets on average where a step holds what it gets, in a sort or a hash table.
ROWS_A_TASK = 250_000


def tasks_for(*tables: DataFrame) -> int:
    """Tasks for a step over the rows of the largest table: at least a shuffle's, and more as rows grow, so that no task holds more.

    The rows are counted: for tables of files, and columns worked out of them, that reads footers only.
    """
    return max(width(tables[0].sparkSession), *[-(-df.count() // ROWS_A_TASK) for df in tables])


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by its keys to tasks_for(df) tasks; what is grouped or numbered by these keys, or by them and more, stays there."""
    return df.repartition(tasks_for(df), *keys)
