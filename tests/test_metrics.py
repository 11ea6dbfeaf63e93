"""Metric points: sentinel, non-finite values, duplicates, late data, stream = batch."""

import math
import os

from pyspark.sql import functions as F

from tessera.streaming import changelog
from tessera.streaming import metrics as M
from tessera.streaming import status as ST

ROLLUP = ["window_start_ms", "name", "series"]
BASE = 1_700_000_000_000


def pts(spark, rows):
    return spark.createDataFrame(
        [(n, "gauge", v, t, s, "optimizer", "ms", {"device": "0"}) for n, v, t, s in rows], M.POINT_SCHEMA)


def test_non_finite_round_trip(spark):
    p = M.decode(M.encode(pts(spark, [("loss", float("nan"), BASE, 1), ("loss", float("inf"), BASE + 1, 2),
                                      ("loss", -float("inf"), BASE + 2, 3), ("loss", 1.5, BASE + 3, 4)])))
    out = sorted((r.step, r.value, r.is_nan) for r in p.collect())
    assert out == [(1, None, True), (2, None, True), (3, None, True), (4, 1.5, False)]


def test_real_minus_999999_without_label_is_kept(spark):
    p = M.decode(pts(spark, [("x", -999999.0, BASE, 1)])).first()
    assert p.value == -999999.0 and not p.is_nan


def test_stream_equals_batch_and_drops_late_points(spark, tmp_dir):
    rows = [("loss", float(k), BASE + k * 1000, k) for k in range(200)]
    src = f"{tmp_dir}/src"
    drain = lambda: M.stream_dedup_to_table(spark, src, f"{tmp_dir}/out", f"{tmp_dir}/ck")
    points = M.encode(pts(spark, rows + rows[:20])).repartition(5)        # restart duplicates, several files a commit
    M.replay(points, "time_unix_ms", lambda part: M.write_points(part, src), drain)
    M.write_points(pts(spark, [("loss", 99.0, BASE - 3_600_000, 999)]), src)  # an hour late, written last
    drain()
    got = sorted(r.step for r in spark.read.parquet(f"{tmp_dir}/out").collect())
    assert got == list(range(200))


def test_rollup_stream_equals_batch(spark, tmp_dir):
    rows = [("loss", float(k % 7), BASE + k * 20_000, k) for k in range(300)]
    p = pts(spark, rows)
    M.replay(p, "time_unix_ms", lambda part: M.write_points(part, f"{tmp_dir}/src"),
             lambda: M.stream_agg_to_changelog(spark, f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ck", M.rollup, ROLLUP, 2))
    assert changelog.snapshot_of(spark, f"{tmp_dir}/out") is not None and len(changelog.batches(spark, f"{tmp_dir}/out")) < 2
    stream = {(r.window_start_ms, r.n, r.v_last) for r in changelog.read(spark, f"{tmp_dir}/out", ROLLUP).collect()}
    batch = {(r.window_start_ms, r.n, r.v_last) for r in M.rollup(M.decode(p)).collect()}
    assert stream == batch


def test_latest_and_step_axis(spark):
    p = M.decode(pts(spark, [("a", 1.0, BASE, 5), ("a", 2.0, BASE + 10, 5), ("a", 3.0, BASE + 5, 6)]))
    assert M.latest(p).first().value == 2.0
    ax = {r.step: r.value for r in M.step_axis(p).collect()}
    assert ax == {5: 2.0, 6: 3.0}
    assert not math.isnan(M.stream_list(p).first().n_points)


def test_commits_are_bounded_by_rows(spark):
    from pyspark.sql import functions as F
    from tessera.streaming import metrics as M
    rows = spark.range(3000).select(F.when(F.col("id") < 2990, F.col("id")).otherwise(F.col("id") * 1000).alias("t"))  # nearly all in one range
    sizes, seen = [], []

    def save(part):
        got = [r.t for r in part.collect()]
        assert not seen or not got or min(got) > max(seen)
        sizes.append(len(got))
        seen.extend(got)
    M.replay(rows, "t", save, lambda: None, commit_rows=125)  # of each of four cores
    assert sum(sizes) == 3000 and max(sizes) <= 500


def test_commits_are_few_where_rows_are_many(spark):
    rows, sizes = spark.range(1_100_000).withColumnRenamed("id", "t"), []
    M.replay(rows, "t", lambda part: sizes.append(part.count()), lambda: None, commit_rows=M.COMMIT_ROWS)
    assert sum(sizes) == 1_100_000 and len(sizes) == M.COMMITS  # every commit is a restart of the stream; before, five


def test_a_replayed_batch_changes_nothing(spark, tmp_dir):
    path, key = f"{tmp_dir}/log", ["k"]
    delta = lambda rows: spark.createDataFrame(rows, "k long, v string")
    state = lambda: sorted(tuple(r) for r in changelog.read(spark, path, key).collect())
    for b, rows in enumerate([[(1, "a"), (2, "a")], [(1, "b")], [(3, "c")]]):
        changelog.append(delta(rows), path, b)
        changelog.append(delta(rows), path, b)  # the same batch once more
    assert state() == [(1, "b"), (2, "a"), (3, "c")] and changelog.compact(spark, path, key, 4) is None
    assert changelog.compact(spark, path, key, 3) == 2 and changelog.batches(spark, path) == []
    changelog.append(delta([(1, "old")]), path, 1)  # a batch that the snapshot holds
    assert state() == [(1, "b"), (2, "a"), (3, "c")]
    changelog.append(delta([(2, None), (4, "d")]), path, 3)
    assert state() == [(1, "b"), (2, None), (3, "c"), (4, "d")]
    changelog.append(delta([(5, "e")]), path, 4)
    assert changelog.compact(spark, path, key, 2) == 4 and changelog.snapshot_of(spark, path) == 4
    assert state() == [(1, "b"), (2, None), (3, "c"), (4, "d"), (5, "e")]


def test_accepted_and_rejected_add_up_to_the_input_after_a_restart(spark, tmp_dir):
    rows = [("loss" if k % 5 else None, float(k), BASE + k * 1000 if k % 7 else None, k) for k in range(300)]
    late = [("loss", 1.0, BASE - 10 * 60_000, 900), ("loss", 2.0, BASE + 299_000 - 59_000, 901)]  # ten minutes, and just in time
    src, out, ck = (f"{tmp_dir}/{x}" for x in ("src", "out", "ck"))
    drain = lambda: M.stream_accept_reject(spark, src, out, ck)
    M.write_points(pts(spark, rows).repartition(3), src)
    drain()
    M.write_points(pts(spark, late), src)
    drain()
    drain()  # nothing new
    import shutil
    table = lambda x: spark.read.parquet(f"{out}/{x}/delta/*")
    want = {"no name": 60, "no time": sum(k % 7 == 0 and k % 5 != 0 for k in range(300)), "late": 1}
    for again in (False, True):
        if again:  # the last batch runs once more, as after a crash before its commit
            for f in os.listdir(f"{ck}/commits"):
                if f.strip(".").startswith("1"):
                    os.remove(f"{ck}/commits/{f}")
            drain()
        assert {r.reason: r["count"] for r in table("rejected").groupBy("reason").count().collect()} == want
        assert table("accepted").count() == len(rows) + len(late) - sum(want.values())
        ledger = table("ledger").agg(F.sum("n").alias("n"), F.sum("accepted").alias("a"), F.sum("late").alias("l")).first()
        assert (ledger.n, ledger.a, ledger.l) == (302, table("accepted").count(), 1)
    assert not [f for f in os.listdir(f"{out}/staged") if not f.startswith(".")]
    del shutil


def test_pyramid_levels_give_what_raw_points_give(spark, tmp_dir):
    import random
    rng = random.Random(6)
    rows = [("loss" if k % 3 else "lr", rng.choice([1.5, -2.0, float("nan"), 7.0]), BASE + rng.randrange(0, 40 * 86_400_000), k) for k in range(800)]
    p = M.decode(M.encode(pts(spark, rows)))
    M.pyramid(p, f"{tmp_dir}/pyr")
    for lo, hi, most in ((BASE, BASE + 3_600_000 * 30, 40), (BASE, BASE + 40 * 86_400_000, 50), (BASE + 5, BASE + 86_400_000 * 3, 10), (BASE, BASE + 40 * 86_400_000, 3)):
        width = M.pick_width(lo, hi, most)
        got = {r.window_start_ms: (r.v_min, r.v_max, r.n, r.v_last) for r in M.query_range(spark, f"{tmp_dir}/pyr", "loss", lo, hi, most, {"device": "0"}).collect()}
        want = {}
        for r in sorted(p.where("name = 'loss'").collect(), key=lambda r: (r.time_unix_ms, r.step)):
            w = r.time_unix_ms // width * width
            if lo // width * width <= w <= hi:
                a = want.get(w, (None, None, 0, None))
                v = r.value
                want[w] = a if v is None else (v if a[0] is None else min(a[0], v), v if a[1] is None else max(a[1], v), a[2] + 1, v)
        assert got == want and len(got) <= most
    plan = M.query_range(spark, f"{tmp_dir}/pyr", "loss", BASE, BASE + 1000, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and "PushedFilters: [IsNotNull(window_start_ms)" in plan


STATUSES = ["Queued", "Queued", "Running", None, "Running", "Running", "Success", "Running", "Failed"]


def plain_events(polls, heartbeats):
    """polls in order: (t, id, status) -> (k, status, prev, event)."""
    out, last = [], None
    for k, (_, _, s) in enumerate(polls):
        change = last is None or (s is not None and s != last)
        if change or heartbeats:
            out.append((k + 1, s, last, "change" if change else "heartbeat"))
        last = s
        if s in ("Success", "Failed", "Terminated"):
            break
    return out


def test_status_stream_orders_raw_polls_and_drops_late_ones(spark, tmp_dir):
    import datetime as dt
    import random
    rng = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    polls, want = [], {}
    for job in range(1, 7):  # job 1 has half of all polls, many at one instant
        n = 400 if job == 1 else rng.randrange(3, 90)
        mine = sorted((rng.randrange(0, 3600), 1000 * job + k, rng.choice(STATUSES if job != 1 else STATUSES[:6])) for k in range(n))
        polls += [(job, t0 + dt.timedelta(seconds=s), i, x) for s, i, x in mine]
        want[job] = plain_events(mine, True)
    cut = [p for p in polls if p[1] < t0 + dt.timedelta(minutes=30)], [p for p in polls if p[1] >= t0 + dt.timedelta(minutes=30)]
    src, out, ck = (f"{tmp_dir}/{x}" for x in ("src", "out", "ck"))
    save = lambda rows: spark.createDataFrame(rows, ST.POLLS).repartition(3).write.mode("append").parquet(src)
    drain = lambda: ST.stream_status_events(spark, src, out, ck, heartbeats=True, page=16)
    early = {}
    for k, part in enumerate(cut):
        rng.shuffle(part)
        for half in (part[::2], part[1::2]):  # polls of one time range in two commits, each out of order
            save(half)
        drain()
        early[k] = spark.read.schema(ST.EVENTS).parquet(out).count()
    save([(1, t0, 1, "Failed")])  # an hour late: it must not end job 1
    save([(9, t0 + dt.timedelta(hours=2), 5, "Running")])  # time goes on
    drain()
    got = {}
    for r in spark.read.schema(ST.EVENTS).parquet(out).collect():
        got.setdefault(r.job_id, []).append((r.k, r.status, r.prev_status, r.event))
    assert {j: sorted(v) for j, v in got.items()} == want
    assert 0 < early[0] < early[1] < sum(map(len, want.values()))  # polls are held until the watermark has passed them


def test_status_state_grows_with_buckets_not_with_jobs(spark, tmp_dir):
    import datetime as dt
    import random
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    jobs = [None, *range(-150, 150), (1 << 62) + 1, (1 << 62) + 2]  # too large for a float, which nulls must not make of them
    polls, want = [], {}
    for n, job in enumerate(jobs):
        mine = sorted((rng.randrange(0, 3600), 100 * n + k + (1 << 60), rng.choice(STATUSES)) for k in range(rng.randrange(1, 12)))
        mine = [(mine[0][0] - 1, None, "Queued"), *mine]  # a null event_id is the first of its instant
        polls += [(job, t0 + dt.timedelta(seconds=s), i, x) for s, i, x in mine]
        want[job] = plain_events(mine, True)
    src, out, ck = (f"{tmp_dir}/{x}" for x in ("src", "out", "ck"))
    for part in ([p for p in polls if p[1] < t0 + dt.timedelta(minutes=20)], [p for p in polls if p[1] >= t0 + dt.timedelta(minutes=20)],
                 [(ST.CLOCK_JOB, t0 + dt.timedelta(hours=2), 0, None)]):
        rng.shuffle(part)
        spark.createDataFrame(part, ST.POLLS).repartition(3).write.mode("append").parquet(src)
        ST.stream_status_events(spark, src, out, ck, heartbeats=True, page=16, buckets=3)
    got = {}
    for r in spark.read.schema(ST.EVENTS).parquet(out).collect():
        got.setdefault(r.job_id, []).append((r.k, r.status, r.prev_status, r.event))
    assert {j: sorted(v) for j, v in got.items()} == want
    state = spark.read.format("statestore").option("stateVarName", "bucket").load(ck)
    assert state.count() <= 4  # three buckets, and the one of polls without a job_id; before, one row a job


def test_many_polls_of_a_bucket_make_few_runs(spark, tmp_dir):
    import datetime as dt
    import random
    rng = random.Random(12)
    t0 = dt.datetime(2024, 1, 1)
    mine = sorted((rng.randrange(0, 40), k, rng.choice(STATUSES[:6])) for k in range(400))  # none ends the job
    polls = [(1, t0 + dt.timedelta(seconds=s), i, x) for s, i, x in mine]
    rng.shuffle(polls)
    src, out, ck = (f"{tmp_dir}/{x}" for x in ("src", "out", "ck"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "20")  # twenty chunks
    try:
        for part in (polls, [(ST.CLOCK_JOB, t0 + dt.timedelta(hours=2), 0, None)]):
            spark.createDataFrame(part, ST.POLLS).repartition(3).write.mode("append").parquet(src)
            ST.stream_status_events(spark, src, out, ck, heartbeats=True, page=16, buckets=1)
            state = spark.read.format("statestore").option("stateVarName", "bucket").load(ck)
            if part is polls:  # the watermark has passed none of them
                (runs,) = [len(r.runs) // 24 for r in state.select("value.runs").collect()]
    finally:
        spark.conf.set(key, old)
    got = [(r.k, r.status, r.prev_status, r.event) for r in spark.read.schema(ST.EVENTS).parquet(out).collect()]
    assert sorted(got) == plain_events(mine, True)
    assert runs == 3  # before, one run a chunk: 20
