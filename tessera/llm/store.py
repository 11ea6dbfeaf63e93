"""Intermediate tables in the shared folder (``spark.checkpoint.dir``).

A written table cuts lineage: it survives lost executors, is computed once
and read back with column pruning.  Nothing here touches a machine-local
folder; the folder is whatever file system the cluster names.  The tables go
when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def table_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SENT: list[Broadcast] = []


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """``value`` sent to the tasks; ``release_broadcasts`` takes it off the executors again."""
    _SENT.append(spark.sparkContext.broadcast(value))
    return _SENT[-1]


def release_broadcasts() -> None:
    """Take what was sent so far off the executors, for use when its results are written; whoever still needs it is sent it anew."""
    while _SENT:
        _SENT.pop().unpersist()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` column names, each with underscores before it until no name of ``names`` equals it."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
