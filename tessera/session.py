"""Spark session and cluster-level settings shared by every job.

Scale notes
-----------
* AQE is on: it coalesces small shuffle partitions, splits skewed join
  partitions and switches sort-merge joins to broadcast at run time when a
  side turns out small.  Static broadcast hints are used only for sides whose
  size is bounded by construction (keyword lists, vocabularies of literals).
* ``spark.sql.shuffle.partitions`` is left to the caller: 8 in tests, a few
  thousand on a 1000-executor cluster (``default_parallelism`` below).
* Lineage is cut with tables written to the shared folder named by
  ``spark.checkpoint.dir``.  We only set that folder when the cluster has
  not, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of DataFrames that are no longer referenced are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Texts may be long: a batch for Python is bounded in bytes, not only in rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # ANSI mode would turn a bad cast in a malformed corpus row into a
    # failed job; corpus jobs must be total, so bad values become null.
    "spark.sql.ansi.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tessera", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply session-level settings to a session someone else built."""
    for k in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.ansi.enabled"):
        spark.conf.set(k, _BASE_CONF[k])
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers (once per SparkContext).

    Arrow functions that live in the package (the stateful stream, the GAE
    folds) are unpickled on executors; the package is zipped and added with
    ``addPyFile``, as ``--py-files`` would on spark-submit.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, cached nowhere, safe from lost executors."""
    import uuid
    path = scratch_path(df.sparkSession, f"cut-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written table; the application's tables go when it ends."""
    top = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if top not in _TO_DELETE:
        _TO_DELETE.add(top)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(conf)
        fs.mkdirs(path)  # a path must exist to be marked
        fs.deleteOnExit(path)
    return f"{top}/{name}"


_TO_DELETE: set[str] = set()
