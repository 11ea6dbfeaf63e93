"""Metric points: encode, sink, stream source, roll-ups, latest values, dedup (M1-M6, A18, S12-S14); M7 is in ``status``.

The same column functions serve batch and stream: ``decode`` / ``rollup`` /
``latest`` take any DataFrame, so a stream replayed from the metric files
gives the batch result on the same rows (checked in the tests).

Streaming policy (ours; the reference polls files every 5 s and has no late
data rule): event time = ``time_unix_ms``, watermark 1 minute.  Later rows are
dropped where a stream keeps state, and go to a reject table with their reason
in ``stream_accept_reject``.  Update-mode aggregates are written per
micro-batch as deltas and compacted into snapshots (``changelog``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.render import NAN_SENTINEL, encode_non_finite
from ..session import scratch_path
from . import changelog

POINT_SCHEMA = ("name string, kind string, value double, time_unix_ms long, step long, step_domain string, "
                "unit string, labels map<string,string>")
WATERMARK = "1 minute"


def labels_key(labels: Column) -> Column:
    """Canonical text of a labels map (entries sorted by key) -- a groupable series key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def encode(points: DataFrame) -> DataFrame:
    """Non-finite values become the sentinel with label nan=true (as the writer does)."""
    e = encode_non_finite(F.col("value"), F.col("labels"))
    cols = [c for c in points.columns if c not in ("value", "labels")]
    return points.select(*cols, e["value"].alias("value"), e["labels"].alias("labels"))


def decode(points: DataFrame) -> DataFrame:
    """M1: validate and parse points; the sentinel is decoded back to null (flag ``is_nan``)."""
    is_nan = (F.col("value") == NAN_SENTINEL) & (F.element_at("labels", F.lit("nan")) == "true")
    valid = F.col("name").isNotNull() & F.col("time_unix_ms").isNotNull()
    return (points.where(valid)
            .withColumn("is_nan", F.coalesce(is_nan, F.lit(False)))
            .withColumn("value", F.when(F.col("is_nan"), F.lit(None).cast("double")).otherwise(F.col("value")))
            .withColumn("time", F.timestamp_millis("time_unix_ms"))
            .withColumn("series", labels_key(F.map_filter("labels", lambda k, _: k != "nan"))))


def rollup(points: DataFrame, every: str = "1 hour") -> DataFrame:
    """M2: tumbling roll-up per series: min, max, avg, count and last value (latest time, then step)."""
    return (points.groupBy(F.window("time", every).alias("w"), "name", "series")
            .agg(F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_avg"),
                 F.count("value").alias("n"),
                 F.max_by("value", F.struct("time_unix_ms", "step")).alias("v_last"))
            .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"), "name", "series",
                    "v_min", "v_max", "v_avg", "n", "v_last"))


def latest(points: DataFrame) -> DataFrame:
    """M5: latest value of each series (by time, then step)."""
    return points.groupBy("name", "series").agg(
        F.max_by("value", F.struct("time_unix_ms", "step")).alias("value"),
        F.max("time_unix_ms").alias("time_unix_ms"))


def step_axis(points: DataFrame) -> DataFrame:
    """M4: one value per (series, step domain, step): the latest point wins."""
    return points.groupBy("name", "series", "step_domain", "step").agg(
        F.max_by("value", F.struct("time_unix_ms")).alias("value"), F.count(F.lit(1)).alias("n_points"))


def dedup_key() -> list[str]:
    """M6: a duplicate is the same point re-appended after a restart (value included)."""
    return ["name", "series", "step", "time_unix_ms", "value"]


def stream_list(points: DataFrame) -> DataFrame:
    """Distinct streams (name + labels) with point count and time range."""
    return points.groupBy("name", "series").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("time_unix_ms").alias("first_ms"),
        F.max("time_unix_ms").alias("last_ms"))


def downsample(points: DataFrame, max_points: int) -> DataFrame:
    """M3: at most ``max_points`` points per series, a uniform stride over the time order.

    Points that tie in time, step and value are equal in every returned column, so the order is
    unique as far as results go; a hot series is ranked by range, not in one task.
    """
    from ..operators.joins import null_safe_join
    from ..operators.ordering import rank_within
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    p = points.select("name", "series", "time_unix_ms", "step", "value")
    n = p.groupBy("name", "series").agg(F.count(F.lit(1)).alias("_n"))
    r = null_safe_join(rank_within(p, ["name", "series"], ["time_unix_ms", "step", "value"], "_rn"), n, ["name", "series"])
    return (r.where((F.col("_rn") - 1) % F.ceil(F.col("_n") / F.lit(max_points)) == 0)
            .select("name", "series", "time_unix_ms", "step", "value"))


def csv_export(points: DataFrame, path: str) -> None:
    """CSV with labels flattened to device and node columns."""
    (points.select("name", "time_unix_ms", "step", "value",
                   F.element_at("labels", F.lit("device")).alias("device"),
                   F.element_at("labels", F.lit("node")).alias("node"))
     .write.mode("overwrite").option("header", True).csv(path))


def write_points(points: DataFrame, path: str) -> None:
    """Metric-point sink (JSON Lines, nulls kept), one append; every partition writes its own files."""
    points.write.mode("append").option("ignoreNullFields", False).json(path)


COMMITS = 4
COMMIT_ROWS = 1 << 20  # of one core: a restart, a plan and two micro-batches cost some seconds a commit, however few its rows


def replay(df: DataFrame, time_col: str, save, drain, commits: int = COMMITS, commit_rows: int | None = None) -> None:
    """Feed a stream the way a live writer and a scheduled reader do.

    ``df`` is cut into ``commits`` consecutive ranges of ``time_col``.  Each range is appended by ``save`` (as many
    tasks as the range has partitions) and then read to its end by ``drain``, the stream started with
    ``availableNow`` on its checkpoint.  A micro-batch is one whole commit, so the order of files within a commit
    does not matter and no row comes behind the watermark of an earlier commit.

    With ``commit_rows``, a larger table is cut at quantiles of the time instead, into as many commits as keep each
    to that many rows per core of the cluster; rows of one instant stay together.
    """
    spark = df.sparkSession
    t = F.col(time_col).cast("double") if dict(df.dtypes)[time_col] in ("bigint", "int", "double") \
        else F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    if lo is None:
        save(df)
        return drain()
    n = df.count() if commit_rows else 0
    commit_rows = commit_rows and commit_rows * max(1, spark.sparkContext.defaultParallelism)
    if commit_rows and n > commit_rows:
        commits = max(commits, -(-2 * n // commit_rows))  # half full on average: quantiles are approximate
        timed = df.select(t.alias("t")).where("t is not null")
        cuts = sorted(set(timed.approxQuantile("t", [k / commits for k in range(1, commits)], 0.2 / commits)))
        bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= t)), F.lit(0))
        bucket = F.when(t.isNull(), 0).otherwise(bucket)
        commits = len(cuts) + 1
    else:
        bucket = F.coalesce(F.least(F.floor((t - F.lit(lo)) * commits / F.lit((hi - lo) or 1.0)), F.lit(commits - 1)).cast("int"), F.lit(0))
    staged = scratch_path(spark, f"staged-{uuid.uuid4().hex}")
    df.withColumn("_commit", bucket).write.partitionBy("_commit").parquet(staged)  # computed once, for all commits
    table = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_commit", T.IntegerType())])).parquet(staged)
    for k in range(commits):
        save(table.where(F.col("_commit") == k).drop("_commit"))
        drain()


def read_points_stream(spark: SparkSession, path: str) -> DataFrame:
    """Metric directory as a stream (several files per run); schema is fixed, not inferred."""
    return spark.readStream.schema(POINT_SCHEMA).json(path)


def start_stateful(spark: SparkSession, start):
    """Start a stateful stream with one state partition per available core.

    The number of state-store partitions is taken from
    ``spark.sql.shuffle.partitions`` when a query first starts and is then
    fixed in its checkpoint; batch-oriented settings (200, or thousands on a
    cluster sized for shuffles) would make every micro-batch visit that many
    stores.  ``defaultParallelism`` grows with the cluster.
    """
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        return start()
    finally:
        spark.conf.set(key, old)


def run_available(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stream_dedup_to_table(spark: SparkSession, src: str, out: str, ckpt: str) -> None:
    """M1 + M6 as a stream: decode, drop duplicates within the watermark, append to Parquet (exactly once)."""
    s = decode(read_points_stream(spark, src)).withWatermark("time", WATERMARK) \
        .dropDuplicatesWithinWatermark(dedup_key())
    q = start_stateful(spark, lambda: s.writeStream.format("parquet").option("checkpointLocation", ckpt)
                       .option("path", out).outputMode("append").trigger(availableNow=True).start())
    run_available(q)


def stream_agg_to_changelog(spark: SparkSession, src: str, out: str, ckpt: str, agg, key: list[str], every: int = 8) -> None:
    """Update-mode aggregate -> one delta per micro-batch, compacted into a snapshot after ``every`` of them."""
    s = agg(decode(read_points_stream(spark, src)).withWatermark("time", WATERMARK))

    def sink(df: DataFrame, batch_id: int) -> None:
        changelog.append(df, out, batch_id)
        changelog.compact(spark, out, key, every)

    q = start_stateful(spark, lambda: s.writeStream.outputMode("update").option("checkpointLocation", ckpt)
                       .foreachBatch(sink).trigger(availableNow=True).start())
    run_available(q)


# ---------------------------------------------------------------- M1 with a reject path

LATE_MS = 60_000


def reject_reason(points: DataFrame, seen_ms: Column | None = None, late_ms: int = LATE_MS) -> Column:
    """Why a raw point is refused: no name, no time, or more than ``late_ms`` before ``seen_ms``; null if it is accepted."""
    late = F.col("time_unix_ms") < seen_ms - late_ms if seen_ms is not None else F.lit(False)
    return (F.when(F.col("name").isNull(), "no name").when(F.col("time_unix_ms").isNull(), "no time")
            .when(F.coalesce(late, F.lit(False)), "late"))


def stream_accept_reject(spark: SparkSession, src: str, out: str, ckpt: str, late_ms: int = LATE_MS) -> None:
    """M1: every point of the stream goes to ``out/accepted`` or, with its reason, to ``out/rejected``.

    Both tables and a ledger (counts and greatest time, observed while writing) have one folder per batch id; a batch
    replayed after a restart overwrites its own folders and sees the ledgers before it only, so accepted and rejected
    rows add up to the input.
    """
    from pyspark.sql import Observation

    def sink(df: DataFrame, batch_id: int) -> None:
        before = [b for b in changelog.batches(spark, f"{out}/ledger") if b < batch_id]
        seen = changelog.read_batches(spark, f"{out}/ledger", before).agg(F.max("max_time_ms")).first()[0] if before else None
        o = Observation()
        marked = df.withColumn("reason", reject_reason(df, F.lit(seen).cast("long"), late_ms))
        counts = [F.count_if(c).alias(n) for n, c in (("accepted", F.col("reason").isNull()), ("no_name", F.col("reason") == "no name"),
                                                     ("no_time", F.col("reason") == "no time"), ("late", F.col("reason") == "late"))]
        marked = marked.observe(o, F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("reason").isNull(), F.col("time_unix_ms"))).alias("max_time_ms"), *counts)
        staged = changelog.folder(f"{out}/staged", batch_id)
        marked.write.mode("overwrite").parquet(staged)  # the batch is computed once, for both tables
        whole = spark.read.schema(marked.schema).parquet(staged)
        changelog.append(whole.where("reason is null").drop("reason"), f"{out}/accepted", batch_id)
        changelog.append(whole.where("reason is not null"), f"{out}/rejected", batch_id)
        got = o.get
        row = spark.range(1).select(*[F.lit(got[c]).cast("long").alias(c) for c in ("n", "max_time_ms", "accepted", "no_name", "no_time", "late")])
        changelog.append(row.withColumn("max_time_ms", F.greatest(F.col("max_time_ms"), F.lit(seen).cast("long"))), f"{out}/ledger", batch_id)
        changelog.remove(spark, staged)
    run_available(read_points_stream(spark, src).writeStream.option("checkpointLocation", ckpt).foreachBatch(sink).trigger(availableNow=True).start())


# ---------------------------------------------------------------- M2 / M3 as a pyramid of mergeable aggregates

WIDTHS_MS = [60_000, 600_000, 3_600_000, 21_600_000, 86_400_000, 604_800_000]


def pyramid(points: DataFrame, path: str, widths: list[int] | None = None) -> None:
    """Write (min, max, sum, count, last) per series and window, at every width; a coarser level comes from the finer one.

    Folders are by level and name, rows sorted by time, so a query reads one level of one name and prunes by time.
    """
    widths = sorted(widths or WIDTHS_MS)
    if any(b % a for a, b in zip(widths, widths[1:])):
        raise ValueError("every width must be a multiple of the one before")
    spark, key = points.sparkSession, ["name", "series", "window_start_ms"]
    start = lambda c, w: (F.col(c) - F.pmod(F.col(c), F.lit(w))).alias("window_start_ms")
    last = lambda c: F.max(c).alias("last")
    each = points.select("name", "series", start("time_unix_ms", widths[0]), "value",
                         F.when(F.col("value").isNotNull(), F.struct("time_unix_ms", "step", "value")).alias("last"))
    level = each.groupBy(*key).agg(F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.sum("value").alias("v_sum"),
                                   F.count("value").alias("n"), last("last"))
    for k, width in enumerate(widths):
        if k:
            level = finer.groupBy("name", "series", start("window_start_ms", width)) \
                .agg(F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"), F.sum("v_sum").alias("v_sum"), F.sum("n").alias("n"), last("last"))
        folder = f"{path}/width={width}"
        level.sortWithinPartitions("name", "window_start_ms").write.mode("overwrite").partitionBy("name").parquet(folder)
        finer = spark.read.schema(level.schema).parquet(folder)


def pick_width(from_ms: int, to_ms: int, max_points: int, widths: list[int] | None = None) -> int:
    """The finest width with at most ``max_points`` windows that meet [from_ms, to_ms]; beyond the coarsest level, a multiple of it."""
    widths = sorted(widths or WIDTHS_MS)
    most = lambda w: to_ms // w - from_ms // w + 1 <= max_points
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    width = next((w for w in widths if most(w)), None)
    k = 1
    while width is None:  # a range that meets time zero takes two windows at any width
        k *= 2
        width = k * widths[-1] if most(k * widths[-1]) or k > 1 << 32 else None
    return width


def query_range(spark: SparkSession, path: str, name: str, from_ms: int, to_ms: int, max_points: int, labels: dict[str, str] | None = None,
                widths: list[int] | None = None) -> DataFrame:
    """(window_start_ms, v_min, v_max, v_avg, n, v_last) of a metric over the series with these labels, from one level; no raw point is read."""
    width = pick_width(from_ms, to_ms, max_points, widths)
    level = max(w for w in widths or WIDTHS_MS if width % w == 0)
    kind = ("name string, series string, window_start_ms long, v_min double, v_max double, v_sum double, n long, "
            "last struct<time_unix_ms: long, step: long, value: double>")
    rows = spark.read.schema(kind).parquet(f"{path}/width={level}") \
        .where((F.col("name") == name) & F.col("window_start_ms").between(from_ms // width * width, to_ms))
    for k, v in (labels or {}).items():
        rows = rows.where(F.element_at(F.from_json("series", "map<string,string>"), F.lit(k)) == v)
    start = F.col("window_start_ms") - F.pmod(F.col("window_start_ms"), F.lit(width))
    return rows.groupBy(start.alias("window_start_ms")).agg(
        F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"), (F.sum("v_sum") / F.sum("n")).alias("v_avg"), F.sum("n").alias("n"),
        F.max("last")["value"].alias("v_last"))


def new_run_dirs(spark: SparkSession, name: str) -> dict[str, str]:
    """Fresh source / output / checkpoint folders under the shared checkpoint folder."""
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    return {k: f"{base}/{k}" for k in ("src", "out", "ckpt")}
