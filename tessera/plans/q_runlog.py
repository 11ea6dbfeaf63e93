"""Training-log jobs (W1-W5, W7-W9, A11-A13, A15, A19, A20) on ``events``, ``embeddings`` and ``pages``.

Training log from ``events``: run = event_type, step = position by time,
loss = value / 10.  Losses are also kept as integer milli-units so running
and moving sums are exact in any summation order (job and oracle then divide
the same two integers).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import runlog as RL
from ..sources import tables
from .catalog import register
from .common import r6

EPOCH_STEPS = 500
ACCUM = 4


def training_log(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    r = O.rank_within(e, ["event_type"], ["ts", "event_id"], "step")
    milli = F.round(F.col("value") * 100).cast("bigint")
    i = F.col("event_id")
    return r.select(
        F.col("event_type").alias("run_id"), "event_id", "ts", "step",
        (F.col("step") - 1).alias("pos"),
        (F.floor((F.col("step") - 1) / EPOCH_STEPS) + 1).alias("epoch"),
        ((F.col("step") - 1) % EPOCH_STEPS + 1).alias("pos_in_epoch"),
        milli.alias("loss_milli"), (milli / 1000.0).alias("train_loss"),
        F.when(i % 97 == 0, F.lit(float("nan"))).when(i % 89 == 0, F.lit(float("inf")))
        .otherwise(milli / 1000.0).alias("raw_loss"),
        F.when(F.col("step") % 100 == 0, F.col("value") / 20).alias("eval_loss"),
        F.col("value").alias("step_seconds"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"))


LOG_SQL = """
lg0 AS (SELECT event_type AS run_id, event_id, ts, value, CAST(json_extract(props, '$.k') AS INTEGER) AS tokens,
               row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events),
lg AS (SELECT run_id, event_id, ts, step, step - 1 AS pos, (step - 1) // 500 + 1 AS epoch, (step - 1) % 500 + 1 AS pos_in_epoch,
              CAST(round(value * 100) AS BIGINT) AS loss_milli, CAST(round(value * 100) AS BIGINT) / 1000.0 AS train_loss,
              CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 89 = 0 THEN 'Infinity'::DOUBLE
                   ELSE CAST(round(value * 100) AS BIGINT) / 1000.0 END AS raw_loss,
              CASE WHEN step % 100 = 0 THEN value / 20 END AS eval_loss, value AS step_seconds, tokens
       FROM lg0)"""


def _smooth(spark, sf_dir, mode):
    log = training_log(spark, sf_dir)
    s = RL.smooth_loss(log, mode, "run_id", "pos", "loss_milli")
    return s.select("run_id", "step", r6(F.col("smoothed") / 1000.0).alias("smooth_loss"))


@register("smooth_loss_reference", "WITH " + LOG_SQL + """
SELECT run_id, step, CASE WHEN count(*) OVER (PARTITION BY run_id) >= 10 THEN round(
  sum(loss_milli) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)
  / least(pos + 1, 10) / 1000.0, 6) END AS smooth_loss FROM lg""")
def smooth_loss_reference(spark, sf_dir):
    """W1, reference mode: up to 11 values summed, divided by min(i + 1, 10) (Q7 kept)."""
    return _smooth(spark, sf_dir, "reference")


@register("smooth_loss_mean", "WITH " + LOG_SQL + """
SELECT run_id, step, CASE WHEN count(*) OVER (PARTITION BY run_id) >= 10 THEN round(
  sum(loss_milli) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
  / count(*) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 1000.0, 6) END
  AS smooth_loss FROM lg""")
def smooth_loss_mean(spark, sf_dir):
    """W1, corrected mode: plain mean of the last 10 values."""
    return _smooth(spark, sf_dir, "mean")


@register("running_epoch_loss", "WITH " + LOG_SQL + """
SELECT run_id, step, epoch, round(sum(loss_milli) OVER w / count(*) OVER w / 1000.0, 6) AS running_loss
FROM lg WINDOW w AS (PARTITION BY run_id, epoch ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def running_epoch_loss(spark, sf_dir):
    """Running mean of the loss within each epoch."""
    m = RL.running_mean(training_log(spark, sf_dir), ["run_id", "epoch"], "pos_in_epoch", "loss_milli", "rm")
    return m.select("run_id", "step", "epoch", r6(F.col("rm") / 1000.0).alias("running_loss"))


@register("optimizer_steps", "WITH " + LOG_SQL + """,
pe AS (SELECT run_id, epoch, count(*) AS n FROM lg GROUP BY run_id, epoch),
pb AS (SELECT run_id, epoch, n, coalesce(sum(ceil(n / 4)) OVER (PARTITION BY run_id ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pe)
SELECT lg.run_id, lg.step, CAST(before + ceil(pos_in_epoch / 4) AS BIGINT) AS opt_step,
       pos_in_epoch % 4 = 0 OR pos_in_epoch = n AS is_update
FROM lg JOIN pb ON lg.run_id = pb.run_id AND lg.epoch = pb.epoch""")
def optimizer_steps(spark, sf_dir):
    """Optimiser step under gradient accumulation of 4; last partial group counts."""
    o = RL.optimizer_steps(training_log(spark, sf_dir), "run_id", "epoch", "pos_in_epoch", ACCUM)
    return o.select("run_id", "step", F.col("opt_step").cast("bigint").alias("opt_step"), "is_update")


@register("slow_steps", "WITH " + LOG_SQL + """
SELECT run_id, step, epoch, step_seconds > 30 AS is_slow, step_seconds > 10 AND step_seconds <= 30 AS is_warn,
       CAST(sum(CASE WHEN step_seconds > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, epoch ORDER BY pos
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slow_so_far
FROM lg""")
def slow_steps(spark, sf_dir):
    """Slow-step flags and running slow count per epoch (step seconds = event value)."""
    s = RL.slow_steps(training_log(spark, sf_dir), "run_id", "epoch", "pos_in_epoch", "step_seconds")
    return s.select("run_id", "step", "epoch", "is_slow", "is_warn", F.col("slow_so_far").cast("bigint"))


@register("loss_first_last", "WITH " + LOG_SQL + """
SELECT run_id, min(step) AS first_step, arg_min(train_loss, step) AS first_loss,
       max(step) AS last_step, arg_max(train_loss, step) AS last_loss FROM lg GROUP BY run_id""")
def loss_first_last(spark, sf_dir):
    """First and last loss of each run."""
    return RL.first_last(training_log(spark, sf_dir), "run_id", "step", "train_loss")


@register("curriculum_level", """
WITH ep AS (SELECT event_type AS run_id, CAST(ts AS DATE) AS day, avg(value) / 10 AS mean_reward
            FROM events GROUP BY event_type, CAST(ts AS DATE)),
e2 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY day) AS idx FROM ep)
SELECT run_id, idx AS episode, round(mean_reward, 6) AS mean_reward,
  sum(CASE WHEN mean_reward > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING)
  * CAST(0.05 AS DOUBLE) AS level
FROM e2""")
def curriculum_level(spark, sf_dir):
    """Curriculum level after each episode (episode = run and day, reward = mean value / 10)."""
    e = tables.load(spark, sf_dir, "events")
    ep = e.groupBy(F.col("event_type").alias("run_id"), F.to_date("ts").alias("day")) \
        .agg((F.avg("value") / 10).alias("mean_reward"))
    ep = O.rank_within(ep, ["run_id"], ["day"], "episode")
    c = RL.curriculum(ep, "run_id", "episode", "mean_reward")
    return c.select("run_id", "episode", r6(F.col("mean_reward")).alias("mean_reward"), F.col("level"))


STATUS_MAP = {"click": "Queued", "signup": "Preparing", "view": "Running", "purchase": "Success", "error": "Failed"}


def _status_col():
    c = F.lit(None).cast("string")
    for k, v in STATUS_MAP.items():
        c = F.when(F.col("event_type") == k, F.lit(v)).otherwise(c)
    return c


@register("status_changes", """
WITH p AS (SELECT user_id AS job_id, ts AS polled_at,
              CASE event_type WHEN 'click' THEN 'Queued' WHEN 'signup' THEN 'Preparing' WHEN 'view' THEN 'Running'
                              WHEN 'purchase' THEN 'Success' WHEN 'error' THEN 'Failed' END AS status,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
q AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY k) AS prev_status FROM p),
t AS (SELECT job_id, min(k) AS k_end FROM p WHERE status IN ('Success', 'Failed', 'Terminated') GROUP BY job_id)
SELECT q.job_id, q.k, q.polled_at, q.status, q.prev_status FROM q LEFT JOIN t ON q.job_id = t.job_id
WHERE (t.k_end IS NULL OR q.k <= t.k_end) AND (q.prev_status IS NULL OR q.prev_status <> q.status)""")
def status_changes(spark, sf_dir):
    """Status change log per job, stopping at the first terminal status (job = user, poll = event)."""
    e = tables.load(spark, sf_dir, "events")
    p = e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("polled_at"), "event_id",
                 _status_col().alias("status"))
    p = O.rank_within(p, ["job_id"], ["polled_at", "event_id"], "k")
    return RL.status_changes(p, "job_id", "k", "status").select("job_id", "k", "polled_at", "status", "prev_status")


@register("checkpoint_retention", "WITH " + LOG_SQL + """
SELECT run_id, step, rk FROM (
  SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rk FROM lg
  WHERE eval_loss IS NOT NULL) WHERE rk <= 3""")
def checkpoint_retention(spark, sf_dir):
    """Keep the newest 3 checkpoints (evaluation rows) of each run."""
    ck = training_log(spark, sf_dir).where(F.col("eval_loss").isNotNull()).select("run_id", "step")
    ck = O.rank_within(ck, ["run_id"], [F.col("step").desc()], "rk")
    return RL.keep_newest(ck, "run_id", "rk", 3).select("run_id", "step", "rk")


@register("eval_loss_report", "WITH " + LOG_SQL + """,
b AS (SELECT run_id, pos // 8 AS batch, avg(train_loss) AS bm, sum(train_loss * tokens) AS lw, sum(tokens) AS tw
      FROM lg GROUP BY run_id, pos // 8)
SELECT run_id, count(*) AS n_batches, round(coalesce(avg(bm), 0.0), 6) AS eval_loss,
       round(sum(lw) / sum(tw), 6) AS eval_loss_token_weighted FROM b GROUP BY run_id""")
def eval_loss_report(spark, sf_dir):
    """Evaluation loss as mean of batch means (batches of 8) and token-weighted."""
    log = training_log(spark, sf_dir).withColumn("batch", F.floor(F.col("pos") / 8))
    r = RL.eval_loss_report(log, "run_id", "batch", "train_loss", "tokens")
    return r.select("run_id", "n_batches", r6(F.col("eval_loss")).alias("eval_loss"),
                    r6(F.col("eval_loss_token_weighted")).alias("eval_loss_token_weighted"))


@register("epoch_summary", "WITH " + LOG_SQL + """
SELECT run_id, epoch, count(*) AS n_steps,
  round(avg(CASE WHEN isnan(raw_loss) OR isinf(raw_loss) THEN 0.0 ELSE raw_loss END), 6) AS mean_loss,
  count(*) FILTER (WHERE isnan(raw_loss) OR isinf(raw_loss)) AS nan_count,
  count(*) FILTER (WHERE tokens < 5) AS skipped, count(*) FILTER (WHERE step_seconds > 30) AS slow_steps,
  round(sum(step_seconds), 6) AS elapsed_sec
FROM lg GROUP BY run_id, epoch""")
def epoch_summary(spark, sf_dir):
    """Per-epoch summary with non-finite losses counted as 0."""
    s = RL.epoch_summary(training_log(spark, sf_dir), "run_id", "epoch", "raw_loss", "step_seconds",
                         F.col("tokens") < 5)
    return s.select("run_id", "epoch", "n_steps", r6(F.col("mean_loss")).alias("mean_loss"), "nan_count",
                    "skipped", "slow_steps", r6(F.col("elapsed_sec")).alias("elapsed_sec"))


@register("run_summary", "WITH " + LOG_SQL + """
, m AS (SELECT run_id, max(step) AS last_step, count(eval_loss) AS n_eval_rows FROM lg GROUP BY run_id)
SELECT m.run_id, m.last_step, lg.epoch, lg.train_loss, lg.eval_loss, m.n_eval_rows
FROM m JOIN lg ON m.run_id = lg.run_id AND m.last_step = lg.step""")
def run_summary(spark, sf_dir):
    """Last log row and number of evaluation rows per run."""
    return RL.run_summary(training_log(spark, sf_dir), "run_id", "step", ["epoch", "train_loss", "eval_loss"],
                          "eval_loss")


@register("best_checkpoint", "WITH " + LOG_SQL + """
SELECT run_id, arg_min(step, (eval_loss, step)) AS best_step, min(eval_loss) AS best_eval_loss
FROM lg WHERE eval_loss IS NOT NULL GROUP BY run_id""")
def best_checkpoint(spark, sf_dir):
    """Checkpoint with the lowest evaluation loss per run."""
    return RL.best_checkpoint(training_log(spark, sf_dir), "run_id", "step", "eval_loss")


@register("classification_report", """
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings),
y AS (SELECT vec_id // 64 AS batch, label, list_position(z, list_max(z)) - 1 AS prediction,
             ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[label + 1] AS loss FROM x),
b AS (SELECT batch, avg(loss) AS bl, count(*) AS n, count(*) FILTER (WHERE label = prediction) AS ok FROM y GROUP BY batch)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(ok) * 100.0 / sum(n), 6) AS accuracy_pct, round(avg(bl), 6) AS loss FROM b""")
def classification_report(spark, sf_dir):
    """Accuracy and batch-mean cross-entropy of an argmax classifier over all components."""
    e = tables.load(spark, sf_dir, "embeddings")
    z = F.transform("embedding", lambda v: v.cast("double"))
    p = e.select((F.floor(F.col("vec_id") / 64)).alias("batch"), "label", z.alias("z")).select(
        "batch", "label", (F.array_position("z", F.array_max("z")) - 1).cast("int").alias("prediction"),
        (F.log(F.aggregate(F.transform("z", lambda v: F.exp(v)), F.lit(0.0), lambda a, b: a + b))
         - F.element_at("z", F.col("label") + 1)).alias("loss"))
    r = RL.classification_report(p, [], "batch", "label", "prediction", "loss")
    return r.select(F.col("n").cast("bigint"), r6(F.col("accuracy_pct")).alias("accuracy_pct"),
                    r6(F.col("loss")).alias("loss"))


@register("next_version", r"""
SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS lang, max(CAST(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT)) + 1
       AS next_version
FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+') GROUP BY 1""")
def next_version(spark, sf_dir):
    """Next version = highest numbered name + 1, per language folder of the page URLs."""
    p = tables.load(spark, sf_dir, "pages").where(F.col("url").rlike("/[a-z]{2}/[0-9]+"))
    v = F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1).cast("bigint")
    return RL.next_version(p.withColumn("lang", F.regexp_extract("url", "/([a-z]{2})/", 1)), ["lang"], v)


@register("logged_steps", "WITH " + LOG_SQL + """
SELECT run_id, step, train_loss FROM lg WHERE step % 50 = 0""")
def logged_steps(spark, sf_dir):
    """rows at the logging cadence (every 50th step)."""
    return RL.logging_cadence(training_log(spark, sf_dir), "step", 50).select("run_id", "step", "train_loss")


@register("new_versions", r"""
WITH ex AS (SELECT DISTINCT regexp_extract(url, '/([a-z]{2})/', 1) AS lang,
                   CAST(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS BIGINT) AS version
            FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+')),
c AS (SELECT lang, max(version) + d AS version FROM ex, (VALUES (0), (1)) t(d) GROUP BY lang, d)
SELECT lang, version, NOT EXISTS (SELECT 1 FROM ex WHERE ex.lang = c.lang AND ex.version = c.version) AS accepted
FROM c""")
def new_versions(spark, sf_dir):
    """J7 + A20: candidate versions (latest and latest + 1); one that exists already is refused."""
    p = tables.load(spark, sf_dir, "pages").where(F.col("url").rlike("/[a-z]{2}/[0-9]+"))
    ex = p.select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"),
                  F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1).cast("bigint").alias("version")).distinct()
    top = ex.groupBy("lang").agg(F.max("version").alias("v"))
    cand = top.select("lang", F.explode(F.array(F.col("v"), F.col("v") + 1)).alias("version"))
    ok, refused = RL.refuse_existing(cand, ex, ["lang", "version"])
    return ok.withColumn("accepted", F.lit(True)).unionByName(refused.withColumn("accepted", F.lit(False)))
