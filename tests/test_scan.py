"""Scans over block trees against plain loops, for block sizes that need several levels."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rl, scan


def rows_of(seed, sizes, start=0):
    rng = random.Random(seed)
    return [(g, i, rng.randint(-9, 9)) for g, n in sizes.items() for i in range(start, start + n)]


@pytest.mark.parametrize("block, start", [(2, 0), (3, 1), (4096, 0)])
def test_running_sums_over_several_levels(spark, block, start):
    rows = rows_of(1, {"hot": 150, "b": 7, None: 20, "one": 1}, start)
    df = spark.createDataFrame(rows, "g string, i long, x long")
    got = {(r.g, r.i): (r.s, r.n) for r in scan.prefix_sums(df, ["g"], "i", {"s": F.col("x"), "n": F.lit(1)}, block).collect()}
    assert len(got) == len(rows)
    for g in {g for g, *_ in rows}:
        total = 0
        for k, (_, i, x) in enumerate(r for r in rows if r[0] == g):
            total += x
            assert got[(g, i)] == (total, k + 1)


def test_nulls_are_skipped_by_running_sums(spark):
    df = spark.createDataFrame([("a", k, None if k < 5 else k) for k in range(12)], "g string, i long, x long")
    got = [r.s for r in scan.prefix_sums(df, ["g"], "i", {"s": F.col("x")}, 2).orderBy("i").collect()]
    assert got[:5] == [None] * 5 and got[5:] == [sum(range(5, k + 1)) for k in range(5, 12)]


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_previous_rows_cross_blocks(spark, block):
    rows = rows_of(2, {"hot": 60, None: 11, "one": 1}, 1)
    df = spark.createDataFrame(rows, "g string, i long, x long")
    out = scan.with_previous(df, ["g"], "i", {"x": "before"}, block)
    assert out.columns == ["g", "i", "x", "before"]
    got = {(r.g, r.i): r.before for r in out.collect()}
    want = {(g, i): next((y for h, j, y in rows if h == g and j == i - 1), None) for g, i, _ in rows}
    assert got == want


@pytest.mark.parametrize("block", [2, 3, 64])
def test_affine_recurrence_over_several_levels(spark, block):
    rng = random.Random(3)
    rows = [(g, i, rng.random(), rng.choice([0.0, 0.5, 0.9, 1.0])) for g, n in {1: 130, None: 9, 5: 1}.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, a double, f double")
    got = {(r.g, r.i): r.value for r in scan.fold_back(df, ["g"], "i", lambda e, _: (e["a"], e["f"]), ["a", "f"], block=block).collect()}
    for g in (1, None, 5):
        value = 0.0
        for _, i, a, f in reversed([r for r in rows if r[0] == g]):
            value = a + f * value
            assert got[(g, i)] == pytest.approx(value, rel=1e-12)


def test_no_python_and_no_window_over_a_group_in_gae(spark):
    df = spark.range(3000).selectExpr("1 as traj_id", "id as t", "1.0D as reward", "0.5D as v", "0 as death")
    plan = rl.gae(df)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Window" not in plan
    assert rl.gae(df).count() == 3000
