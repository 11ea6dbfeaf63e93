"""Metric-stream jobs (M1-M7, A18, P14, S12-S14) over points derived from ``events``.

Point: name = event_type, value = event value (NaN planted for event_id % 97 = 0,
written as the sentinel), time = ts, step = event_id div 10, labels = device
(user) and node (user mod 4).  The *_stream jobs write the points as JSON
files (S12), replay them with Structured Streaming (S13) and return what the
stream wrote; their oracles are the batch results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables
from ..streaming import changelog
from ..streaming import metrics as M
from ..streaming import status as ST
from .catalog import register
from .common import r6
from .q_runlog import _status_col


def raw_points(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    i = F.col("event_id")
    p = e.select(
        F.col("event_type").alias("name"), F.lit("gauge").alias("kind"),
        F.when(i % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_unix_ms"),
        F.floor(i / 10).cast("long").alias("step"), F.lit("optimizer").alias("step_domain"),
        F.lit("ms").alias("unit"),
        F.create_map(F.lit("device"), F.col("user_id").cast("string"),
                     F.lit("node"), F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string"))).alias("labels"))
    return M.encode(p)


def with_restart_duplicates(points):
    """Points re-appended after a simulated restart (every step divisible by 10 sent twice)."""
    return points.unionByName(points.where(F.col("step") % 10 == 0))


def points(spark, sf_dir):
    return M.decode(raw_points(spark, sf_dir))


PT_SQL = """
pt AS (SELECT event_type AS name, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value,
              event_id % 97 = 0 AS is_nan, epoch_us(ts) // 1000 AS time_unix_ms, event_id // 10 AS step,
              'optimizer' AS step_domain, CAST(user_id AS VARCHAR) AS device, 'n' || CAST(user_id % 4 AS VARCHAR) AS node,
              '{"device":"' || CAST(user_id AS VARCHAR) || '","node":"n' || CAST(user_id % 4 AS VARCHAR) || '"}' AS series
       FROM events)"""

ROLLUP_SQL = "WITH " + PT_SQL + """
SELECT time_unix_ms // 3600000 * 3600000 AS window_start_ms, name, series, min(value) AS v_min, max(value) AS v_max,
       round(avg(value), 6) AS v_avg, count(value) AS n, arg_max_null(value, (time_unix_ms, step)) AS v_last
FROM pt GROUP BY 1, name, series"""

ROLLUP_KEY = ["window_start_ms", "name", "series"]

LATEST_SQL = "WITH " + PT_SQL + """
SELECT name, series, arg_max_null(value, (time_unix_ms, step)) AS value, max(time_unix_ms) AS time_unix_ms
FROM pt GROUP BY name, series"""

DEDUP_SQL = "WITH " + PT_SQL + """
SELECT DISTINCT name, series, step, time_unix_ms, value, is_nan FROM pt"""


@register("metric_points", "WITH " + PT_SQL + """
SELECT name, series, time_unix_ms, step, value, is_nan FROM pt""")
def metric_points(spark, sf_dir):
    """M1 + P14: encoded points parsed back; the sentinel becomes null with is_nan."""
    return points(spark, sf_dir).select("name", "series", "time_unix_ms", "step", "value", "is_nan")


def _rollup_out(df):
    return df.select("window_start_ms", "name", "series", "v_min", "v_max", r6(F.col("v_avg")).alias("v_avg"),
                     "n", "v_last")


@register("metric_rollup", ROLLUP_SQL)
def metric_rollup(spark, sf_dir):
    """M2: hourly roll-up per series (min, max, avg, count, last)."""
    return _rollup_out(M.rollup(points(spark, sf_dir)))


@register("metric_downsample", "WITH " + PT_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY name, series ORDER BY time_unix_ms, step, value NULLS FIRST) AS rn,
             count(*) OVER (PARTITION BY name, series) AS n FROM pt)
SELECT name, series, time_unix_ms, value FROM r WHERE (rn - 1) % CAST(ceil(n / 5) AS BIGINT) = 0""")
def metric_downsample(spark, sf_dir):
    """M3: uniform down-sampling to at most 5 points per series (stride over the time order)."""
    return M.downsample(points(spark, sf_dir), 5).select("name", "series", "time_unix_ms", "value")


@register("metric_step_axis", "WITH " + PT_SQL + """
SELECT name, series, step_domain, step, arg_max_null(value, time_unix_ms) AS value, count(*) AS n_points
FROM pt GROUP BY name, series, step_domain, step""")
def metric_step_axis(spark, sf_dir):
    """M4: step axis -- one value per (series, step), latest point wins."""
    return M.step_axis(points(spark, sf_dir))


@register("metric_latest", LATEST_SQL)
def metric_latest(spark, sf_dir):
    """M5: latest value per series."""
    return M.latest(points(spark, sf_dir))


@register("metric_dedup", DEDUP_SQL)
def metric_dedup(spark, sf_dir):
    """M6: duplicates re-appended after a restart are dropped."""
    p = M.decode(with_restart_duplicates(raw_points(spark, sf_dir)))
    return p.dropDuplicates(M.dedup_key()).select("name", "series", "step", "time_unix_ms", "value", "is_nan")


@register("metric_streams", "WITH " + PT_SQL + """
SELECT name, series, count(*) AS n_points, min(time_unix_ms) AS first_ms, max(time_unix_ms) AS last_ms
FROM pt GROUP BY name, series""")
def metric_streams(spark, sf_dir):
    """List of metric streams with point counts and time range."""
    return M.stream_list(points(spark, sf_dir))


def _replayed_points(spark, sf_dir, name, stream, duplicates=True):
    """Folders of a run whose points were written and read commit by commit; ``stream`` takes the folders."""
    d = M.new_run_dirs(spark, name)
    p = raw_points(spark, sf_dir)
    M.replay(with_restart_duplicates(p) if duplicates else p, "time_unix_ms", lambda part: M.write_points(part, d["src"]),
             lambda: stream(d))
    return d


@register("metric_points_stream", DEDUP_SQL)
def metric_points_stream(spark, sf_dir):
    """S12 + S13 + M1 + M6 streamed: JSON point files replayed, decoded, de-duplicated within the watermark."""
    d = _replayed_points(spark, sf_dir, "points", lambda x: M.stream_dedup_to_table(spark, x["src"], x["out"], x["ckpt"]))
    return spark.read.parquet(d["out"]).select("name", "series", "step", "time_unix_ms", "value", "is_nan")


@register("metric_latest_stream", LATEST_SQL)
def metric_latest_stream(spark, sf_dir):
    """M5 streamed: latest value per series, update mode, changelog read back."""
    d = _replayed_points(spark, sf_dir, "latest", lambda x: M.stream_agg_to_changelog(spark, x["src"], x["out"], x["ckpt"], M.latest, ["name", "series"], 3))
    return changelog.read(spark, d["out"], ["name", "series"]).select("name", "series", "value", "time_unix_ms")


@register("metric_rollup_stream", ROLLUP_SQL)
def metric_rollup_stream(spark, sf_dir):
    """M2 streamed: hourly roll-up with a 1-minute watermark, update mode, changelog read back."""
    d = _replayed_points(spark, sf_dir, "rollup", lambda x: M.stream_agg_to_changelog(spark, x["src"], x["out"], x["ckpt"], M.rollup, ROLLUP_KEY),
                         duplicates=False)
    return _rollup_out(changelog.read(spark, d["out"], ROLLUP_KEY))


@register("metric_csv_export", "WITH " + PT_SQL + """
SELECT name, time_unix_ms, step, CASE WHEN is_nan THEN -999999.0 ELSE value END AS value, device, node FROM pt""")
def metric_csv_export(spark, sf_dir):
    """CSV export with labels flattened to device and node (read back)."""
    d = M.new_run_dirs(spark, "csv")
    M.csv_export(raw_points(spark, sf_dir), d["out"])
    return spark.read.schema("name string, time_unix_ms long, step long, value double, device string, node string") \
        .option("header", True).csv(d["out"])


STATUS_SQL = """
WITH p AS (SELECT user_id AS job_id, ts AS polled_at,
              CASE event_type WHEN 'click' THEN 'Queued' WHEN 'signup' THEN 'Preparing' WHEN 'view' THEN 'Running'
                              WHEN 'purchase' THEN 'Success' WHEN 'error' THEN 'Failed' END AS status,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
q AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY k) AS prev_status FROM p),
t AS (SELECT job_id, min(k) AS k_end FROM p WHERE status IN ('Success', 'Failed', 'Terminated') GROUP BY job_id),
r AS (SELECT q.* FROM q LEFT JOIN t ON q.job_id = t.job_id WHERE t.k_end IS NULL OR q.k <= t.k_end)"""


def _status_stream(spark, sf_dir, heartbeats):
    """Raw polls of all jobs, written in any order within a commit, read by the stateful stream."""
    e = tables.load(spark, sf_dir, "events")
    p = e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("polled_at"), "event_id", _status_col().alias("status"))
    d = M.new_run_dirs(spark, "status")
    save = lambda part: part.write.mode("append").parquet(d["src"])
    drain = lambda: ST.stream_status_events(spark, d["src"], d["out"], d["ckpt"], heartbeats)
    M.replay(p, "polled_at", save, drain, commit_rows=M.COMMIT_ROWS)
    save(ST.clock(spark, p))  # time goes on after the last poll
    drain()
    out = spark.read.schema(ST.EVENTS).parquet(d["out"])
    return out.withColumn("polled_at", F.col("polled_at").cast("timestamp_ntz"))


@register("status_changes_stream", STATUS_SQL + """
SELECT job_id, k, polled_at, status, prev_status FROM r WHERE prev_status IS NULL OR prev_status <> status""")
def status_changes_stream(spark, sf_dir):
    """M7: status change events from a stream of raw polls, ordered in the state behind the watermark."""
    return _status_stream(spark, sf_dir, False).select("job_id", "k", "polled_at", "status", "prev_status")


@register("status_heartbeats_stream", STATUS_SQL + """
SELECT job_id, k, polled_at, status FROM r WHERE prev_status = status""")
def status_heartbeats_stream(spark, sf_dir):
    """M7: heartbeats, the polls that find a job's status unchanged, from the same stream."""
    return _status_stream(spark, sf_dir, True).where("event = 'heartbeat'").select("job_id", "k", "polled_at", "status")


def flawed_points(spark, sf_dir):
    """Points some of which have no name or no time."""
    step = F.col("step")
    return raw_points(spark, sf_dir).withColumn("name", F.when(step % 13 != 0, F.col("name"))) \
        .withColumn("time_unix_ms", F.when(step % 17 != 0, F.col("time_unix_ms")))


@register("metric_rejects_stream", """
WITH p AS (SELECT event_id // 10 AS step FROM events)
SELECT CASE WHEN step % 13 = 0 THEN 'no name' WHEN step % 17 = 0 THEN 'no time' ELSE 'accepted' END AS outcome, count(*) AS n_points
FROM p GROUP BY 1""")
def metric_rejects_stream(spark, sf_dir):
    """M1 streamed with a reject path: every point is in the accepted or, with its reason, in the rejected table."""
    d = M.new_run_dirs(spark, "rejects")
    M.replay(flawed_points(spark, sf_dir), "time_unix_ms", lambda part: M.write_points(part, d["src"]),
             lambda: M.stream_accept_reject(spark, d["src"], d["out"], d["ckpt"]))
    ok = spark.read.parquet(f"{d['out']}/accepted/delta/*").select(F.lit("accepted").alias("outcome"))
    bad = spark.read.parquet(f"{d['out']}/rejected/delta/*").select(F.col("reason").alias("outcome"))
    return ok.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_points"))


def _range_sql(width: str) -> str:
    return "WITH " + PT_SQL + f""", b AS (SELECT min(time_unix_ms) AS lo, max(time_unix_ms) AS hi FROM pt),
w AS (SELECT {width} AS w FROM b)
SELECT time_unix_ms // w * w AS window_start_ms, min(value) AS v_min, max(value) AS v_max, round(sum(value) / count(value), 6) AS v_avg,
       count(value) AS n, arg_max(value, (time_unix_ms, step, value)) FILTER (WHERE value IS NOT NULL) AS v_last
FROM pt, w WHERE name = 'view' AND node = 'n1' GROUP BY 1"""


RANGE_POINTS = 200


@register("metric_range", _range_sql("CASE " + " ".join(
    f"WHEN hi // {w} - lo // {w} + 1 <= {RANGE_POINTS} THEN {w}" for w in M.WIDTHS_MS) + f" ELSE {M.WIDTHS_MS[-1]} END"))
def metric_range(spark, sf_dir):
    """M2 / M3: one metric of one node over the whole time range in at most 200 windows, read from one level of the pyramid."""
    p = points(spark, sf_dir)
    d = M.new_run_dirs(spark, "pyramid")
    M.pyramid(p, d["out"])
    lo, hi = p.agg(F.min("time_unix_ms"), F.max("time_unix_ms")).first()
    r = M.query_range(spark, d["out"], "view", lo or 0, hi or 0, RANGE_POINTS, {"node": "n1"})
    return r.select("window_start_ms", "v_min", "v_max", r6(F.col("v_avg")).alias("v_avg"), "n", "v_last")
