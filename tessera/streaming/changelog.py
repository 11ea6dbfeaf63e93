"""Versioned tables written by ``foreachBatch``: one folder per batch id, compacted into snapshots.

``<path>/delta/<batch>`` holds what a micro-batch changed.  After some deltas
``compact`` merges them with the snapshot before into ``<path>/snapshot/<batch>``
and removes what it replaces.  A reader touches one snapshot and the deltas
since.  Writing a batch again replaces its own folder; a batch that a snapshot
already holds is left out, so a replay after a restart changes nothing.

Folders are listed through the file system that the path names; a folder
counts once its writer has finished it (``_SUCCESS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(path: str, batch_id: int) -> str:
    return f"{path}/{batch_id:012d}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Batch ids of the finished folders under ``path``."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.isDirectory() and fs.exists(done(x.getPath(), "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def snapshot_of(spark: SparkSession, path: str) -> int | None:
    return max(_complete(spark, f"{path}/snapshot"), default=None)


def batches(spark: SparkSession, path: str) -> list[int]:
    """Batch ids of the deltas that no snapshot holds."""
    last = snapshot_of(spark, path)
    return [b for b in _complete(spark, f"{path}/delta") if last is None or b > last]


def append(df: DataFrame, path: str, batch_id: int) -> None:
    """Write what batch ``batch_id`` changed; again, it replaces itself; once in a snapshot, it is left out."""
    last = snapshot_of(df.sparkSession, path)
    if last is None or batch_id > last:
        df.write.mode("overwrite").parquet(folder(f"{path}/delta", batch_id))


def read_batches(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    return spark.read.parquet(*[folder(f"{path}/delta", b) for b in ids])


def read(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The newest row of every key: of the snapshot and the deltas since (rows of a key are in at most one batch's delta once)."""
    last, ids = snapshot_of(spark, path), batches(spark, path)
    parts = [] if last is None else [spark.read.parquet(folder(f"{path}/snapshot", last)).withColumn("_batch", F.lit(-1).cast("long"))]
    parts += [read_batches(spark, path, [b]).withColumn("_batch", F.lit(b).cast("long")) for b in ids]
    if not parts:
        raise FileNotFoundError(f"no batch has been written under {path}")
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    rest = [c for c in whole.columns if c not in (*key, "_batch")]
    newest = F.max_by(F.struct(*rest), F.col("_batch"))
    return whole.groupBy(*key).agg(newest.alias("_r")).select(*key, "_r.*")


def compact(spark: SparkSession, path: str, key: list[str], every: int) -> int | None:
    """Merge the deltas into a new snapshot once there are ``every`` of them; its batch id, or none."""
    ids = batches(spark, path)
    if len(ids) < every:
        return None
    read(spark, path, key).write.mode("overwrite").parquet(folder(f"{path}/snapshot", ids[-1]))
    for b in _complete(spark, f"{path}/delta"):
        if b <= ids[-1]:
            remove(spark, folder(f"{path}/delta", b))
    for b in _complete(spark, f"{path}/snapshot"):
        if b < ids[-1]:
            remove(spark, folder(f"{path}/snapshot", b))
    return ids[-1]
