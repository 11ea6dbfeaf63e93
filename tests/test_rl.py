"""Advantages, GAE and report identities."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import rl


def test_group_advantage_identities(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 5.0), (3, 1.0), (3, 2.0), (3, 6.0)], "g long, reward double")
    out = {(r.g, r.reward): r.advantage for r in rl.group_advantage(df, ["g"]).collect()}
    assert out[(1, 1.0)] == 0.0          # equal rewards: std floor keeps it 0
    assert out[(2, 5.0)] == 0.0          # one-member group: 0, not NaN
    sums = rl.group_advantage(df, ["g"]).groupBy("g").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in sums)


def gae_py(rows, gamma, lam, v_final=0.0):
    A, out = 0.0, {}
    for i in range(len(rows) - 1, -1, -1):
        r, v, d = rows[i]
        vn = rows[i + 1][1] if i + 1 < len(rows) else v_final
        delta = r + gamma * (1 - d) * vn - v
        A = delta + gamma * lam * (1 - d) * A
        out[i] = A
    return out


def _steps(spark, trajs):
    data = [(tid, t, r, v, d) for tid, rows in trajs.items() for t, (r, v, d) in enumerate(rows)]
    return spark.createDataFrame(data, "traj_id long, t long, reward double, v double, death int")


TRAJS = {
    1: [(1.0, 0.5, 0), (0.0, 0.2, 0), (2.0, 1.0, 1), (1.0, 0.3, 0), (0.5, 0.1, 0)],  # death mid-way
    2: [(float(k % 3), 0.1 * k, 1 if k == 17 else 0) for k in range(40)],
    3: [(1.0, 2.0, 0)],
}


@pytest.mark.parametrize("chunk", [4096, 7, 1])
def test_gae_matches_recursion_across_chunks(spark, chunk):
    out = rl.gae(_steps(spark, TRAJS), gamma=0.9, lam=0.8, chunk=chunk).collect()
    got = {(r.traj_id, r.t): r.advantage for r in out}
    for tid, rows in TRAJS.items():
        exp = gae_py(rows, 0.9, 0.8)
        for t, a in exp.items():
            assert got[(tid, t)] == pytest.approx(a, rel=1e-12, abs=1e-12)


def test_gae_last_value_and_lambda_zero(spark):
    lv = spark.createDataFrame([(3, 10.0)], "traj_id long, v_final double")
    out = {(r.traj_id, r.t): r for r in rl.gae(_steps(spark, TRAJS), lv, gamma=0.9, lam=0.0).collect()}
    # lambda = 0: A_t = delta_t; the last step of trajectory 3 uses the final value
    assert out[(3, 0)].advantage == pytest.approx(1.0 + 0.9 * 10.0 - 2.0)
    assert out[(1, 0)].advantage == pytest.approx(1.0 + 0.9 * 0.2 - 0.5)
    assert out[(3, 0)].ret == pytest.approx(out[(3, 0)].advantage + 2.0)


def test_normalise_global(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.0, 3.0, 4.0]], "advantage double")
    vals = [r.advantage_norm for r in rl.normalise_global(df).collect()]
    assert sum(vals) == pytest.approx(0.0, abs=1e-12)


def test_best_worst_pairs(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (1, 12, 0.1), (1, 13, 0.9), (2, 20, 1.0)],
                               "g long, item_id long, reward double")
    out = rl.best_worst_pairs(df, ["g"]).collect()
    assert len(out) == 1 and out[0].chosen_id == 11 and out[0].rejected_id == 12


def test_dpo_loss_at_zero_margin(spark):
    df = spark.createDataFrame([(0, -1.0, -1.0, -1.0, -1.0)], "step long, pol_c double, pol_r double, ref_c double, ref_r double")
    r = rl.dpo_report(df).first()
    assert r.loss == pytest.approx(0.6931471805599453)


def test_reward_hook_accepts_expression_and_pandas_udf(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def length_reward(s: pd.Series) -> pd.Series:
        return s.str.len().astype("float64") / 10.0

    df = spark.createDataFrame([("<think>x</think> v = 3 m/s",), ("abc",)], "text string")
    default = [r.reward for r in rl.score_completions(df).collect()]
    assert default == pytest.approx([1.0, 0.0])
    custom = [r.reward for r in rl.score_completions(df, reward=length_reward).collect()]
    assert custom == pytest.approx([2.6, 0.3])


def test_gae_keeps_a_null_trajectory_and_uses_final_values(spark):
    rows = [(tr, t, 1.0, 0.5, 0) for tr in (None, 1) for t in range(10)]
    df = spark.createDataFrame(rows, "traj_id int, t long, reward double, v double, death int")
    last = spark.createDataFrame([(None, 2.0), (1, 2.0)], "traj_id int, v_final double")
    # lambda = 1: the return is the discounted sum of rewards and of the final value, for any chunking
    for chunk in (3, 4096):
        out = rl.gae(df, last, gamma=0.9, lam=1.0, chunk=chunk).collect()
        assert len(out) == 20
        for r in out:
            left = 10 - r.t
            assert abs(r.ret - (sum(0.9 ** k for k in range(left)) + 2.0 * 0.9 ** left)) < 1e-9
