"""Training-log and evaluation summaries.

A log is a long table (run_id, step, ...).  Running and moving statistics and
previous rows come from ``scan``: no window and no join over a whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join
from .scan import moving_sums, prefix_sums, with_previous

# ---- fixed values (must equal the reference's) ----
SMOOTH_WINDOW = 10
SLOW_SEC, WARN_SEC = 30.0, 10.0
CURRICULUM_STEP, CURRICULUM_THRESHOLD = 0.05, 4.0
TERMINAL_STATUS = ["Success", "Failed", "Terminated"]
# ---------------------------------------------------


def smooth_loss(log: DataFrame, mode: str = "reference", run: str = "run_id", step_idx: str = "pos",
                loss: str = "train_loss") -> DataFrame:
    """Moving average of the loss, only for runs with at least 10 points.

    mode="reference": sums the last 11 values and divides by min(i + 1, 10) (Q7);
    mode="mean": the plain mean of the last 10 values.  ``step_idx`` is the
    dense 0-based position of the row in its run.
    """
    width = SMOOTH_WINDOW + 1 if mode == "reference" else SMOOTH_WINDOW
    m = moving_sums(log, [run], step_idx, loss, width)
    if mode == "reference":
        val = F.col("mov_sum") / F.least(F.col(step_idx) + 1, F.lit(SMOOTH_WINDOW))
    else:
        val = F.col("mov_sum") / F.col("mov_n")
    n = log.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    return (null_safe_join(m, n, [run]).withColumn("smoothed", F.when(F.col("_n") >= SMOOTH_WINDOW, val))
            .drop("mov_sum", "mov_n", "_n"))


def running_mean(log: DataFrame, group: list[str], idx: str, col: str, out: str = "running_mean") -> DataFrame:
    """Mean of ``col`` from the start of the group to the current row."""
    p = prefix_sums(log, group, idx, {"_cs": F.col(col), "_cn": F.lit(1)})
    return p.withColumn(out, F.col("_cs") / F.col("_cn")).drop("_cs", "_cn")


def optimizer_steps(log: DataFrame, run: str, epoch: str, pos_in_epoch: str, accum: int) -> DataFrame:
    """Optimiser step of each micro-step under gradient accumulation.

    Within an epoch the update happens every ``accum`` micro-steps and at the
    last micro-step (a partial group still counts); the global number adds the
    updates of earlier epochs.
    """
    per_epoch = log.groupBy(run, epoch).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    per_epoch = per_epoch.withColumn(
        "_before", F.coalesce(F.sum(F.ceil(F.col("_n") / accum)).over(w), F.lit(0)))
    return (null_safe_join(log, per_epoch, [run, epoch])
            .withColumn("opt_step", F.col("_before") + F.ceil(F.col(pos_in_epoch) / accum))
            .withColumn("is_update", (F.col(pos_in_epoch) % accum == 0) | (F.col(pos_in_epoch) == F.col("_n")))
            .drop("_n", "_before"))


def slow_steps(log: DataFrame, run: str, epoch: str, pos_in_epoch: str, seconds: str) -> DataFrame:
    """Slow (> 30 s) and mildly slow (> 10 s) step flags, running slow count per epoch."""
    flagged = log.withColumn("is_slow", F.col(seconds) > SLOW_SEC) \
        .withColumn("is_warn", (F.col(seconds) > WARN_SEC) & (F.col(seconds) <= SLOW_SEC))
    return prefix_sums(flagged, [run, epoch], pos_in_epoch,
                       {"slow_so_far": F.col("is_slow").cast("long")})


def first_last(log: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """First and last loss of each run (algebraic, partial aggregation)."""
    return log.groupBy(run).agg(
        F.min(step).alias("first_step"), F.min_by(loss, step).alias("first_loss"),
        F.max(step).alias("last_step"), F.max_by(loss, step).alias("last_loss"))


def curriculum(episodes: DataFrame, run: str, idx: str, mean_reward: str) -> DataFrame:
    """Level after each episode = 0.05 x number of episodes so far whose mean reward > 4."""
    p = prefix_sums(episodes, [run], idx,
                    {"_ups": F.when(F.col(mean_reward) > CURRICULUM_THRESHOLD, 1).otherwise(0)})
    return p.withColumn("level", F.col("_ups") * F.lit(CURRICULUM_STEP)).drop("_ups")


def status_changes(polls: DataFrame, job: str, k: str, status: str) -> DataFrame:
    """Polls whose status differs from the previous poll, up to the first terminal status.

    The previous poll comes with the block's halo (``scan.with_previous``); the first terminal poll per
    job is an algebraic min.
    """
    p = with_previous(polls, [job], k, {status: "prev_status"})
    term = polls.where(F.col(status).isin(*TERMINAL_STATUS)).groupBy(job).agg(F.min(k).alias("_end"))
    p = null_safe_join(p, term, [job], "left")
    return (p.where((F.col("_end").isNull() | (F.col(k) <= F.col("_end")))
                    & (F.col("prev_status").isNull() | (F.col("prev_status") != F.col(status))))
            .drop("_end"))


def keep_newest(ckpts: DataFrame, run: str, rank_desc: str, k: int) -> DataFrame:
    """Retention -- keep the newest k checkpoints (rank 1 = newest)."""
    return ckpts.where(F.col(rank_desc) <= k)


def eval_loss_report(rows: DataFrame, run: str, batch: str, loss: str, tokens: str) -> DataFrame:
    """Mean of batch means (0 when there is no batch) and the token-weighted mean."""
    per_batch = rows.groupBy(run, batch).agg(F.avg(loss).alias("_bm"), F.sum(F.col(loss) * F.col(tokens)).alias("_lw"),
                                             F.sum(tokens).alias("_tw"))
    return per_batch.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.coalesce(F.avg("_bm"), F.lit(0.0)).alias("eval_loss"),
        (F.sum("_lw") / F.sum("_tw")).alias("eval_loss_token_weighted"))


def epoch_summary(log: DataFrame, run: str, epoch: str, loss: str, seconds: str, skipped: Column) -> DataFrame:
    """Mean loss with non-finite losses counted as 0, their count, skipped and slow steps, elapsed."""
    finite = ~(F.isnan(F.col(loss)) | (F.abs(F.col(loss)) == float("inf")))
    return log.groupBy(run, epoch).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.avg(F.when(finite, F.col(loss)).otherwise(0.0)).alias("mean_loss"),
        F.count_if(~finite).alias("nan_count"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(F.col(seconds) > SLOW_SEC).alias("slow_steps"),
        F.sum(seconds).alias("elapsed_sec"))


def run_summary(log: DataFrame, run: str, step: str, fields: list[str], eval_col: str) -> DataFrame:
    """The last log row of each run plus the number of evaluation rows."""
    last = F.max_by(F.struct(*[F.col(f) for f in fields]), F.col(step))
    return log.groupBy(run).agg(F.max(step).alias("last_step"), last.alias("_last"),
                                F.count(eval_col).alias("n_eval_rows")) \
        .select(run, "last_step", "_last.*", "n_eval_rows")


def best_checkpoint(ckpts: DataFrame, run: str, step: str, eval_loss: str) -> DataFrame:
    """Checkpoint with the lowest eval loss (ties: earliest step)."""
    best = F.min_by(F.struct(F.col(eval_loss), F.col(step)), F.struct(F.col(eval_loss), F.col(step)))
    return ckpts.where(F.col(eval_loss).isNotNull()).groupBy(run).agg(best.alias("_b")) \
        .select(run, F.col("_b")[step].alias("best_step"), F.col("_b")[eval_loss].alias("best_eval_loss"))


def classification_report(pred: DataFrame, group: list[str], batch: str, label: str, prediction: str,
                          loss: str) -> DataFrame:
    """Accuracy (%) and mean of batch-mean losses."""
    pb = pred.groupBy(*group, batch).agg(F.avg(loss).alias("_bl"), F.count(F.lit(1)).alias("_n"),
                                         F.count_if(F.col(label) == F.col(prediction)).alias("_ok"))
    return pb.groupBy(*group).agg(F.sum("_n").alias("n"),
                                  (F.sum("_ok") * 100.0 / F.sum("_n")).alias("accuracy_pct"),
                                  F.avg("_bl").alias("loss"))


def next_version(names: DataFrame, group: list[str], version: Column) -> DataFrame:
    """Next model version = highest existing version + 1."""
    return names.groupBy(*group).agg((F.max(version) + 1).alias("next_version"))


def logging_cadence(log: DataFrame, step: str, every: int) -> DataFrame:
    """the rows a trainer logs -- every ``every``-th optimiser step (the cadence is the feature)."""
    return log.where(F.col(step) % every == 0)


def refuse_existing(candidates: DataFrame, existing: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) -- a candidate whose version already exists is refused (anti / semi join)."""
    return candidates.join(existing, key, "left_anti"), candidates.join(existing, key, "left_semi")
