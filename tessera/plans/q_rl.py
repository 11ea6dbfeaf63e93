"""RL statistics jobs (A4-A10, A21, J1, W6, W10) on ``documents``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordering as O
from ..operators import rl
from ..sources import tables
from .catalog import register
from .common import r6

WS = T.WS


def token_rows(spark, sf_dir):
    """(seq_id, pos, lp, mask, prompt_len): one row per whitespace token of every whole document."""
    d = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    # per-document values are projected before the explode, so they are computed once per
    # document and the text is not carried along with every token row
    base = d.select(F.col("doc_id").alias("seq_id"),
                    F.size(T.whitespace_tokens(T.first_line(F.col("text")))).alias("prompt_len"),
                    T.whitespace_tokens(F.col("text")).alias("_toks"))
    # explode_outer: a plain explode makes the optimizer add a size(tokens) > 0 filter that splits
    # every text a second time; documents without tokens give one null row, dropped here
    t = base.select("seq_id", "prompt_len", F.posexplode_outer("_toks").alias("pos", "tok")) \
        .where(F.col("pos").isNotNull())
    return t.select("seq_id", "pos", "prompt_len",
                    (-((F.col("seq_id") * 31 + F.col("pos") * 7) % 97) / 97.0).alias("lp"),
                    F.when((F.col("seq_id") + F.col("pos")) % 13 == 12, 0).otherwise(1).alias("mask"))


TOKENS_SQL = rf"""
tk AS (
  SELECT doc_id AS seq_id,
         len(list_filter(regexp_split_to_array(split_part(text, chr(10), 1), '{WS}+'), lambda x: x <> '')) AS prompt_len,
         len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) AS n
  FROM documents),
tok AS (
  SELECT seq_id, prompt_len, pos, -((seq_id * 31 + pos * 7) % 97) / 97.0 AS lp,
         CASE WHEN (seq_id + pos) % 13 = 12 THEN 0 ELSE 1 END AS mask
  FROM (SELECT seq_id, prompt_len, unnest(range(n)) AS pos FROM tk))"""


@register("seq_logprob_mean", "WITH " + TOKENS_SQL + """
SELECT seq_id, round(sum(lp * mask) / greatest(sum(mask), 1), 6) AS lp_mean FROM tok GROUP BY seq_id""")
def seq_logprob_mean(spark, sf_dir):
    """A4: token-mean sequence log-prob over non-pad tokens."""
    return rl.seq_logprob_mean(token_rows(spark, sf_dir)).select("seq_id", r6(F.col("lp_mean")).alias("lp_mean"))


@register("seq_logprob_sum", "WITH " + TOKENS_SQL + """
SELECT seq_id, round(sum(CASE WHEN pos >= prompt_len THEN lp * mask END), 6) AS lp_response,
       round(sum(lp * mask), 6) AS lp_all FROM tok GROUP BY seq_id""")
def seq_logprob_sum(spark, sf_dir):
    """A5: summed response-token and all-token log-probs."""
    s = rl.seq_logprob_sum(token_rows(spark, sf_dir))
    return s.select("seq_id", r6(F.col("lp_response")).alias("lp_response"), r6(F.col("lp_all")).alias("lp_all"))


PAIR_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def dpo_pairs(spark, sf_dir):
    """Policy and reference log-probs of each lineitem pair, joined by the pair key."""
    li = tables.load(spark, sf_dir, "lineitem")
    q = F.col("l_quantity") / 50.0
    pol = li.select(*PAIR_KEY, (F.col("l_orderkey") / 1000).cast("bigint").alias("step"),
                    (-q).alias("pol_c"), (-q - F.col("l_discount")).alias("pol_r"))
    ref = li.select(*PAIR_KEY, (-q - F.col("l_tax") / 2).alias("ref_c"),
                    (-q - F.col("l_discount") - F.col("l_tax")).alias("ref_r"))
    return pol.join(ref, PAIR_KEY)


@register("dpo_report", """
WITH p AS (SELECT l_orderkey // 1000 AS step, -l_quantity / 50.0 AS pol_c, -l_quantity / 50.0 - l_discount AS pol_r,
                  -l_quantity / 50.0 - l_tax / 2 AS ref_c, -l_quantity / 50.0 - l_discount - l_tax AS ref_r
           FROM lineitem),
x AS (SELECT *, 0.1 * ((pol_c - pol_r) - (ref_c - ref_r)) AS z FROM p)
SELECT step, count(*) AS n_pairs,
  round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 6) AS loss,
  round(0.1 * avg(pol_c - ref_c), 6) AS reward_chosen, round(0.1 * avg(pol_r - ref_r), 6) AS reward_rejected,
  round(avg(pol_c - ref_c), 6) AS kl_chosen, round(avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM x GROUP BY step""")
def dpo_report(spark, sf_dir):
    """A6 + J1: DPO loss, implicit rewards, KL and accuracy per step."""
    r = rl.dpo_report(dpo_pairs(spark, sf_dir), beta=0.1)
    return r.select("step", "n_pairs", *[r6(F.col(c)).alias(c) for c in
                                         ["loss", "reward_chosen", "reward_rejected", "kl_chosen", "accuracy"]])


@register("reward_model_report", """
WITH p AS (SELECT l_returnflag, l_extendedprice / 10000 - l_discount AS rc, l_extendedprice / 10000 - l_tax AS rr
           FROM lineitem)
SELECT l_returnflag, count(*) AS n_pairs,
  round(avg(greatest(-(rc - rr), 0) + ln(1 + exp(-abs(rc - rr)))), 6) AS loss,
  round(avg(rc), 6) AS chosen_reward, round(avg(rr), 6) AS rejected_reward
FROM p GROUP BY l_returnflag""")
def reward_model_report(spark, sf_dir):
    """Pairwise reward-model loss and side means per return flag."""
    li = tables.load(spark, sf_dir, "lineitem")
    p = li.select("l_returnflag", (F.col("l_extendedprice") / 10000 - F.col("l_discount")).alias("r_chosen"),
                  (F.col("l_extendedprice") / 10000 - F.col("l_tax")).alias("r_rejected"))
    r = rl.reward_model_report(p, ["l_returnflag"])
    return r.select("l_returnflag", "n_pairs", *[r6(F.col(c)).alias(c) for c in
                                                 ["loss", "chosen_reward", "rejected_reward"]])


@register("group_advantage", """
WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id, round(CASE WHEN s.n < 2 THEN 0.0 ELSE (e.value - s.m) / greatest(s.sd, 1e-8) END, 6)
       AS advantage
FROM events e JOIN s ON e.user_id = s.user_id""")
def group_advantage(spark, sf_dir):
    """Group-relative advantage, group = user, reward = value."""
    e = tables.load(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("reward"))
    a = rl.group_advantage(e, ["user_id"])
    return a.select("event_id", "user_id", r6(F.col("advantage")).alias("advantage"))


def rollouts(spark, sf_dir):
    """(step, prompt_id, g, reward, old_lp, new_lp, ref_lp) from events: step = day, prompt = user."""
    e = tables.load(spark, sf_dir, "events")
    i = F.col("event_id")
    r = e.select(F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("bigint").alias("step"), F.col("user_id").alias("prompt_id"),
                 "event_id", F.col("value").alias("reward"),
                 (-((i * 13) % 17) / 17.0).alias("old_lp"), (-((i * 7) % 19) / 19.0).alias("new_lp"),
                 (-((i * 5) % 23) / 23.0).alias("ref_lp"))
    return O.rank_within(r, ["step", "prompt_id"], ["event_id"], "g")


ROLLOUT_SQL = """
r AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, user_id AS prompt_id, event_id,
             value AS reward, -((event_id * 13) % 17) / 17.0 AS old_lp, -((event_id * 7) % 19) / 19.0 AS new_lp,
             -((event_id * 5) % 23) / 23.0 AS ref_lp FROM events),
rg AS (SELECT *, row_number() OVER (PARTITION BY step, prompt_id ORDER BY event_id) AS g FROM r),
st AS (SELECT step, prompt_id, avg(reward) AS m, stddev_samp(reward) AS sd, count(*) AS n FROM rg GROUP BY step, prompt_id),
a AS (SELECT rg.*, CASE WHEN st.n < 2 THEN 0.0 ELSE (reward - st.m) / greatest(st.sd, 1e-8) END AS adv,
             exp(new_lp - old_lp) AS ratio, new_lp - ref_lp AS kl
      FROM rg JOIN st ON rg.step = st.step AND rg.prompt_id = st.prompt_id)"""


@register("grpo_report", "WITH " + ROLLOUT_SQL + """,
pg AS (SELECT step, g, -avg(least(ratio * adv, greatest(least(ratio, 1.2), 0.8) * adv)) AS pg_loss, avg(kl) AS kl,
              avg(CASE WHEN abs(ratio - 1) > 0.2 THEN 1.0 ELSE 0.0 END) AS clip FROM a GROUP BY step, g),
ps AS (SELECT step, count(*) AS n_g, avg(kl) AS mean_kl, avg(clip) AS clip_ratio, avg(pg_loss + 0.04 * kl) AS loss
       FROM pg GROUP BY step),
pa AS (SELECT step, count(*) AS n_rollouts, avg(reward) AS reward_mean, stddev_samp(reward) AS reward_std,
              avg(adv) AS advantage_mean FROM a GROUP BY step)
SELECT pa.step, n_rollouts, round(reward_mean, 6) AS reward_mean, round(reward_std, 6) AS reward_std,
       round(advantage_mean, 6) AS advantage_mean, n_g, round(mean_kl, 6) AS mean_kl,
       round(clip_ratio, 6) AS clip_ratio, round(loss, 6) AS loss
FROM pa JOIN ps ON pa.step = ps.step""")
def grpo_report(spark, sf_dir):
    """GRPO step statistics (rewards, KL, clip ratio, advantage mean, clipped loss)."""
    r = rl.grpo_report(rollouts(spark, sf_dir), clip=0.2, kl_coef=0.04)
    return r.select("step", "n_rollouts", "n_g", *[r6(F.col(c)).alias(c) for c in
                    ["reward_mean", "reward_std", "advantage_mean", "mean_kl", "clip_ratio", "loss"]])


def ppo_batch(spark, sf_dir):
    li = tables.load(spark, sf_dir, "lineitem")
    from ..functions.rewards import combined_reward
    q = F.col("l_quantity") / 50.0
    reward = combined_reward(q - 0.5, F.col("l_discount") * 10 - 0.5)
    return li.select(F.col("l_returnflag").alias("epoch"), (F.col("l_orderkey") / 1000).cast("bigint").alias("step"),
                     reward.alias("reward"), (-q).alias("policy_lp"), (-q - F.col("l_tax")).alias("ref_lp"),
                     (-q).alias("old_lp"), (-q + F.col("l_discount") - 0.05).alias("new_lp"))


PPO_SQL = """
b AS (SELECT l_returnflag AS epoch, l_orderkey // 1000 AS step,
             0.3 * (l_quantity / 50.0 - 0.5) + 0.7 * (l_discount * 10 - 0.5) AS reward,
             -l_quantity / 50.0 AS policy_lp, -l_quantity / 50.0 - l_tax AS ref_lp,
             -l_quantity / 50.0 AS old_lp, -l_quantity / 50.0 + l_discount - 0.05 AS new_lp FROM lineitem),
x AS (SELECT *, policy_lp - ref_lp AS kl, reward - (policy_lp - ref_lp) * 0.1 AS adv, exp(new_lp - old_lp) AS ratio FROM b),
s AS (SELECT epoch, step, -avg(least(ratio * adv, greatest(least(ratio, 1.2), 0.8) * adv)) AS policy_loss,
             avg(kl) AS kl_loss, avg(reward) AS mean_reward FROM x GROUP BY epoch, step),
s2 AS (SELECT *, policy_loss + 0.1 * kl_loss AS loss FROM s)"""


@register("ppo_step_report", "WITH " + PPO_SQL + """
SELECT epoch, step, round(policy_loss, 6) AS policy_loss, round(kl_loss, 6) AS kl_loss,
       round(mean_reward, 6) AS mean_reward, round(loss, 6) AS loss FROM s2""")
def ppo_step_report(spark, sf_dir):
    """A10 + R5: PPO step report with combined reward and KL-penalised advantage."""
    steps, _ = rl.ppo_report(ppo_batch(spark, sf_dir))
    return steps.select("epoch", "step", *[r6(F.col(c)).alias(c) for c in
                                           ["policy_loss", "kl_loss", "mean_reward", "loss"]])


@register("ppo_epoch_report", "WITH " + PPO_SQL + """
SELECT epoch, count(*) AS n_steps, round(avg(loss), 6) AS loss, round(avg(policy_loss), 6) AS policy_loss,
       round(avg(kl_loss), 6) AS kl_loss, round(avg(mean_reward), 6) AS mean_reward FROM s2 GROUP BY epoch""")
def ppo_epoch_report(spark, sf_dir):
    """A10: epoch means of the step report."""
    _, epochs = rl.ppo_report(ppo_batch(spark, sf_dir))
    return epochs.select("epoch", "n_steps", *[r6(F.col(c)).alias(c) for c in
                                               ["loss", "policy_loss", "kl_loss", "mean_reward"]])


def trajectories(spark, sf_dir):
    """(traj_id, t, reward, v, death) from events: a user's events by time."""
    e = tables.load(spark, sf_dir, "events")
    s = e.select(F.col("user_id").alias("traj_id"), "ts", "event_id", F.col("value").alias("reward"),
                 F.get_json_object("props", "$.k").cast("double").alias("v"),
                 (F.col("event_type") == "error").cast("int").alias("death"))
    s = O.rank_within(s, ["traj_id"], ["ts", "event_id"], "_r")
    return s.withColumn("t", F.col("_r") - 1).drop("_r")


GAE_SQL = """
WITH RECURSIVE s AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS r,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS v, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS d
  FROM events),
s2 AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY t), 0.0) AS vn,
              max(t) OVER (PARTITION BY user_id) AS tmax FROM s),
s3 AS (SELECT *, r + CAST(0.95 AS DOUBLE) * (1 - d) * vn - v AS delta FROM s2),
rec AS (SELECT user_id, t, delta AS a, v FROM s3 WHERE t = tmax
        UNION ALL
        SELECT s3.user_id, s3.t, s3.delta + CAST(0.95 AS DOUBLE) * CAST(0.95 AS DOUBLE) * (1 - s3.d) * rec.a, s3.v
        FROM s3 JOIN rec ON s3.user_id = rec.user_id AND s3.t = rec.t - 1)"""


@register("gae", GAE_SQL + """
SELECT user_id AS traj_id, t, round(a, 6) AS advantage, round(a + v, 6) AS ret FROM rec""")
def gae(spark, sf_dir):
    """Generalised advantage estimation per trajectory (gamma = lambda = 0.95, V after end = 0)."""
    g = rl.gae(trajectories(spark, sf_dir), gamma=0.95, lam=0.95)
    return g.select("traj_id", "t", r6(F.col("advantage")).alias("advantage"), r6(F.col("ret")).alias("ret"))


FINAL_V = "coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY t), CAST(user_id % 5 AS DOUBLE) / 10)"


@register("gae_final_values", GAE_SQL.replace("coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY t), 0.0)", FINAL_V) + """
SELECT user_id AS traj_id, t, round(a, 6) AS advantage, round(a + v, 6) AS ret FROM rec""")
def gae_final_values(spark, sf_dir):
    """W6 with a value after the last step of each trajectory (a table of final values, joined by trajectory)."""
    s = trajectories(spark, sf_dir)
    last = s.select("traj_id").distinct().withColumn("v_final", (F.col("traj_id") % 5).cast("double") / F.lit(10))
    g = rl.gae(s, last)
    return g.select("traj_id", "t", r6(F.col("advantage")).alias("advantage"), r6(F.col("ret")).alias("ret"))


@register("gae_normalised", GAE_SQL + """,
st AS (SELECT avg(a) AS m, stddev_samp(a) AS sd FROM rec)
SELECT user_id AS traj_id, t, round((a - m) / (sd + 1e-8), 6) AS advantage_norm FROM rec, st""")
def gae_normalised(spark, sf_dir):
    """GAE advantages normalised over the whole table."""
    g = rl.normalise_global(rl.gae(trajectories(spark, sf_dir)), "advantage", "advantage_norm")
    return g.select("traj_id", "t", r6(F.col("advantage_norm")).alias("advantage_norm"))


@register("best_worst_pairs", """
WITH b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rb,
                  row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rw,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT x.user_id, x.event_id AS chosen_id, x.value AS chosen_score, y.event_id AS rejected_id, y.value AS rejected_score
FROM b x JOIN b y ON x.user_id = y.user_id AND x.rb = 1 AND y.rw = 1 WHERE x.n >= 2""")
def best_worst_pairs(spark, sf_dir):
    """Best vs worst scored completion of each group becomes a preference pair."""
    e = tables.load(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("reward"))
    return rl.best_worst_pairs(e, ["user_id"], "reward", "event_id").select(
        "user_id", "chosen_id", F.col("chosen_score"), "rejected_id", F.col("rejected_score"))
