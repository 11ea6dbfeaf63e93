"""Moving averages (both modes), running means, optimiser steps, status changes."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import runlog as RL
from tessera.operators import scan


# losses 10, 20, 30, ...: smoothed values by hand
SMOOTHED = {
    ("reference", 9): [None] * 9,
    ("mean", 9): [None] * 9,
    ("reference", 12): [10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0, 55.0, 66.0, 77.0],
    ("mean", 12): [10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0, 55.0, 65.0, 75.0],
}


@pytest.mark.parametrize("mode,n", SMOOTHED)
def test_smooth_loss(spark, mode, n):
    df = spark.createDataFrame([("r", k, 10.0 * (k + 1)) for k in range(n)], "run_id string, pos long, train_loss double")
    got = [r.smoothed for r in RL.smooth_loss(df, mode).orderBy("pos").collect()]
    assert got == pytest.approx(SMOOTHED[mode, n]) if n > 9 else got == SMOOTHED[mode, n]


def test_moving_sums_cross_blocks(spark):
    xs = list(range(50))
    df = spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(xs)], "run_id string, pos long, x double")
    got = [r.mov_sum for r in scan.moving_sums(df, ["run_id"], "pos", "x", 4, block=8).orderBy("pos").collect()]
    assert got == [float(sum(xs[max(0, i - 3):i + 1])) for i in range(50)]


def test_prefix_sums_cross_blocks(spark):
    df = spark.createDataFrame([(g, k, float(k)) for g in ("a", "b") for k in range(1, 40)], "g string, i long, x double")
    out = scan.prefix_sums(df, ["g"], "i", {"cs": F.col("x")}, block=5).orderBy("g", "i").collect()
    assert [r.cs for r in out if r.g == "a"] == [float(sum(range(1, k + 1))) for k in range(1, 40)]


def test_optimizer_steps_partial_group(spark):
    rows = [("r", 1, p) for p in range(1, 11)] + [("r", 2, p) for p in range(1, 6)]
    df = spark.createDataFrame(rows, "run_id string, epoch long, pos long")
    out = RL.optimizer_steps(df, "run_id", "epoch", "pos", 4).orderBy("epoch", "pos").collect()
    assert [r.opt_step for r in out] == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 4, 4, 4, 4, 5]
    assert [r.pos for r in out if r.is_update] == [4, 8, 10, 4, 5]


def test_status_changes_stop_at_terminal(spark):
    seq = ["Queued", "Queued", "Running", "Running", "Success", "Running", "Failed"]
    df = spark.createDataFrame([(7, k + 1, s) for k, s in enumerate(seq)], "job long, k long, status string")
    out = RL.status_changes(df, "job", "k", "status").orderBy("k").collect()
    assert [r.status for r in out] == ["Queued", "Running", "Success"]


def test_first_last_and_best_checkpoint(spark):
    df = spark.createDataFrame([("r", 1, 2.0, None), ("r", 2, 1.5, 0.9), ("r", 3, 1.0, 0.7), ("r", 4, 0.8, 0.7)],
                               "run_id string, step long, train_loss double, eval_loss double")
    fl = RL.first_last(df, "run_id", "step", "train_loss").first()
    assert (fl.first_loss, fl.last_loss) == (2.0, 0.8)
    b = RL.best_checkpoint(df, "run_id", "step", "eval_loss").first()
    assert (b.best_step, b.best_eval_loss) == (3, 0.7)


def test_null_groups_are_groups(spark):
    rows = [(g, e, k, float(k)) for g in (None, 1) for e in (None, 2) for k in range(1, 13)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, pos long, x double")
    out = scan.prefix_sums(df, ["run_id", "epoch"], "pos", {"cs": F.col("x")}, block=5).collect()
    assert len(out) == 48 and all(r.cs == r.pos * (r.pos + 1) / 2 for r in out)
    steps = RL.optimizer_steps(df, "run_id", "epoch", "pos", 4).collect()
    assert len(steps) == 48 and sorted({r.opt_step for r in steps if r.run_id is None}) == [1, 2, 3, 4, 5, 6]
    polls = spark.createDataFrame([(None, k, s) for k, s in enumerate("AABBA")], "job int, k long, status string")
    assert [r.k for r in RL.status_changes(polls, "job", "k", "status").orderBy("k").collect()] == [0, 2, 4]
