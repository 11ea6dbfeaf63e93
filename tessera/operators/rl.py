"""Reward, advantage and preference statistics from logged log-probabilities.

Shapes are long tables (one row per token, per completion or per step), so
every statistic is an aggregate with partial (map-side) aggregation, or a
group aggregate joined back on the group key.  Group statistics are never
computed with a window over the group: a window puts a whole group into one
task, a group-by then join lets partial aggregation and AQE's skew-join
split a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import null_safe_join
from .scan import FOLD, fold_back

# ---- fixed values (defaults of the reference) ----
DPO_BETA = 0.1
GRPO_CLIP, GRPO_KL = 0.2, 0.04
PPO_CLIP, PPO_KL = 0.2, 0.1
STD_FLOOR = 1e-8
GAE_GAMMA, GAE_LAMBDA = 0.95, 0.95
# ---------------------------------------------------


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow: max(x, 0) + log1p(exp(-|x|))."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def neg_log_sigmoid(x: Column) -> Column:
    """-log(sigmoid(x)) = softplus(-x)."""
    return softplus(-x)


def seq_logprob_mean(tokens: DataFrame, seq: str = "seq_id") -> DataFrame:
    """A4: token mean of log-probs over non-pad tokens (denominator at least 1)."""
    return tokens.groupBy(seq).agg(
        (F.sum(F.col("lp") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("lp_mean"))


def seq_logprob_sum(tokens: DataFrame, seq: str = "seq_id") -> DataFrame:
    """A5: summed log-prob of response tokens (pos >= prompt_len) and of all non-pad tokens."""
    return tokens.groupBy(seq).agg(
        F.sum(F.when(F.col("pos") >= F.col("prompt_len"), F.col("lp") * F.col("mask"))).alias("lp_response"),
        F.sum(F.col("lp") * F.col("mask")).alias("lp_all"))


def dpo_report(pairs: DataFrame, beta: float = DPO_BETA, step: str = "step") -> DataFrame:
    """Per step, DPO loss, implicit chosen / rejected reward and chosen KL.

    pairs: (step, pol_c, pol_r, ref_c, ref_r) sequence log-probs of one pair per row.
    """
    logits = F.lit(beta) * ((F.col("pol_c") - F.col("pol_r")) - (F.col("ref_c") - F.col("ref_r")))
    return pairs.groupBy(step).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(neg_log_sigmoid(logits)).alias("loss"),
        (F.lit(beta) * F.avg(F.col("pol_c") - F.col("ref_c"))).alias("reward_chosen"),
        (F.lit(beta) * F.avg(F.col("pol_r") - F.col("ref_r"))).alias("reward_rejected"),
        F.avg(F.col("pol_c") - F.col("ref_c")).alias("kl_chosen"),
        F.avg((logits > 0).cast("double")).alias("accuracy"))


def reward_model_report(pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Pairwise loss -log sigmoid(r_c - r_r) and side means; pairs: (r_chosen, r_rejected)."""
    aggs = [F.count(F.lit(1)).alias("n_pairs"),
            F.avg(neg_log_sigmoid(F.col("r_chosen") - F.col("r_rejected"))).alias("loss"),
            F.avg("r_chosen").alias("chosen_reward"), F.avg("r_rejected").alias("rejected_reward")]
    return pairs.groupBy(*(group or [])).agg(*aggs)


def group_stats(df: DataFrame, group: list[str], reward: str = "reward") -> DataFrame:
    """Per-group mean and sample std (one-member group: std null -> advantage 0)."""
    return df.groupBy(*group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std"),
                                  F.count(F.lit(1)).alias("_n"))


def group_advantage(df: DataFrame, group: list[str], reward: str = "reward") -> DataFrame:
    """(r - mean) / max(sample std, 1e-8) within each group.

    The group statistics are a group-by (partial aggregation) joined back on
    the group key; AQE broadcasts the statistics when they are small and
    splits a hot group's partition otherwise.
    """
    st = group_stats(df, group, reward)
    adv = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(
        (F.col(reward) - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(STD_FLOOR)))
    st = st.select(*[F.col(c).alias(f"_s_{c}") for c in group], "_mean", "_std", "_n")
    same = F.lit(True)
    for c in group:  # null is a group like any other
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return df.join(st, same).withColumn("advantage", adv).drop("_mean", "_std", "_n", *[f"_s_{c}" for c in group])


def grpo_report(rollouts: DataFrame, clip: float = GRPO_CLIP, kl_coef: float = GRPO_KL,
                step: str = "step", group: str = "prompt_id", g: str = "g") -> DataFrame:
    """Per step reward mean/std over all completions, mean KL, clip ratio, advantage mean, loss.

    rollouts: (step, prompt_id, g, reward, old_lp, new_lp, ref_lp).  The
    per-g means over prompts are averaged over g, as the reference does.
    """
    a = group_advantage(rollouts, [step, group])
    ratio = F.exp(F.col("new_lp") - F.col("old_lp"))
    kl = F.col("new_lp") - F.col("ref_lp")
    adv = F.col("advantage")
    surr = F.least(ratio * adv, F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip)) * adv)
    per_g = a.groupBy(step, g).agg(
        (-F.avg(surr)).alias("pg_loss"), F.avg(kl).alias("kl"),
        F.avg((F.abs(ratio - 1) > clip).cast("double")).alias("clip"))
    per_step_g = per_g.groupBy(step).agg(
        F.count(F.lit(1)).alias("n_g"), F.avg("kl").alias("mean_kl"), F.avg("clip").alias("clip_ratio"),
        F.avg(F.col("pg_loss") + F.lit(kl_coef) * F.col("kl")).alias("loss"))
    per_step = a.groupBy(step).agg(
        F.count(F.lit(1)).alias("n_rollouts"), F.avg("reward").alias("reward_mean"),
        F.stddev_samp("reward").alias("reward_std"), F.avg("advantage").alias("advantage_mean"))
    return per_step.join(per_step_g, step)


def ppo_report(batch: DataFrame, clip: float = PPO_CLIP, kl_coef: float = PPO_KL,
               step: str = "step", epoch: str = "epoch") -> tuple[DataFrame, DataFrame]:
    """A10: per step loss terms of the KL-penalised clipped objective, and epoch means of them.

    batch: (epoch, step, reward, policy_lp, ref_lp, old_lp, new_lp).
    """
    kl = F.col("policy_lp") - F.col("ref_lp")
    adv = F.col("reward") - kl * F.lit(kl_coef)
    ratio = F.exp(F.col("new_lp") - F.col("old_lp"))
    surr = F.least(ratio * adv, F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip)) * adv)
    steps = batch.groupBy(epoch, step).agg(
        (-F.avg(surr)).alias("policy_loss"), F.avg(kl).alias("kl_loss"), F.avg("reward").alias("mean_reward"))
    steps = steps.withColumn("loss", F.col("policy_loss") + F.lit(kl_coef) * F.col("kl_loss"))
    epochs = steps.groupBy(epoch).agg(
        F.count(F.lit(1)).alias("n_steps"), F.avg("loss").alias("loss"), F.avg("policy_loss").alias("policy_loss"),
        F.avg("kl_loss").alias("kl_loss"), F.avg("mean_reward").alias("mean_reward"))
    return steps, epochs


def normalise_global(df: DataFrame, col: str = "advantage", out: str = "advantage_norm") -> DataFrame:
    """(A - mean) / (std + 1e-8) over the whole table (sample std, as torch).

    The two statistics are one aggregate (partial aggregation, one row back
    to the driver) applied as literals -- no join at all.
    """
    st = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    m = F.lit(st["m"]).cast("double")
    sd = F.lit(st["s"]).cast("double")
    return df.withColumn(out, (F.col(col) - m) / (sd + F.lit(STD_FLOOR)))


def best_worst_pairs(scored: DataFrame, group: list[str], score: str = "reward",
                     item: str = "item_id") -> DataFrame:
    """Per group the highest-scored item is chosen, the lowest rejected (ties: smaller id).

    ``max_by`` / ``min_by`` over a struct are algebraic aggregates, so a hot
    group is pre-aggregated map-side instead of being ranked in one task.
    """
    best = F.max_by(F.struct(F.col(score), -F.col(item)), F.struct(F.col(score), -F.col(item)))
    worst = F.min_by(F.struct(F.col(score), F.col(item)), F.struct(F.col(score), F.col(item)))
    return (scored.groupBy(*group).agg(best.alias("_b"), worst.alias("_w"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= 2)
            .select(*group, (-F.col("_b")["col2"]).alias("chosen_id"), F.col("_b")[score].alias("chosen_score"),
                    F.col("_w")[item].alias("rejected_id"), F.col("_w")[score].alias("rejected_score")))


# ------------------------------------------------------------------ GAE

def gae(steps: DataFrame, last_values: DataFrame | None = None, gamma: float = GAE_GAMMA,
        lam: float = GAE_LAMBDA, traj: str = "traj_id", t: str = "t", chunk: int = FOLD) -> DataFrame:
    """Generalised advantage estimation per trajectory.

    steps: (traj_id, t, reward, v, death) with t = 0..T-1 dense per trajectory;
    last_values: (traj_id, v_final), the value after the last step (0 when absent).

        delta_t = r_t + gamma (1 - d_t) V_{t+1} - V_t
        A_t     = delta_t + gamma lam (1 - d_t) A_{t+1},   A_T = 0,   R_t = A_t + V_t

    Each step is the affine map A -> delta + f A; maps compose in blocks of ``chunk`` steps and blocks of blocks
    (``scan.fold_back``), so a trajectory of any length is many small tasks and nothing leaves the JVM.  V_{t+1}
    stands in the same block, or comes with the first step of the next one.  Inside a block the operations are
    those of the recursion, in its order.
    """
    x = gamma * lam
    s = steps.select(traj, t, F.col("reward").cast("double").alias("r"), F.col("v").cast("double").alias("v"), F.col("death").cast("int").alias("d"))

    def step(e: Column, following: Column) -> tuple[Column, Column]:
        delta = e["r"] + F.lit(gamma) * (1 - e["d"]) * F.coalesce(following["v"], F.lit(0.0)) - e["v"]
        return delta, F.lit(x) * (1 - e["d"])
    after = None
    if last_values is not None:
        after = last_values.select(traj, F.lit(None).cast("double").alias("r"), F.col("v_final").cast("double").alias("v"), F.lit(None).cast("int").alias("d"))
    return fold_back(s, [traj], t, step, ["r", "v", "d"], after, "advantage", chunk, keep=["v"]).withColumn("ret", F.col("advantage") + F.col("v")) \
        .select(traj, t, "advantage", "ret")


def score_completions(df: DataFrame, text: str = "text", reward=None, out: str = "reward") -> DataFrame:
    """Reward hook (the reference's replaceable reward body): ``reward`` is any ``Column -> Column``.

    Built-in expressions keep the scoring inside codegen; a vectorised
    ``pandas_udf`` is accepted as well (Arrow batches, never per row).
    Default: the structural reward R2.
    """
    from ..functions.rewards import structural_reward
    fn = reward or structural_reward
    return df.withColumn(out, fn(F.col(text)))
