"""Stable ranks and indexes without a single-partition window.

``row_number()`` over a window partitioned by a low-cardinality key (or by
nothing) puts a whole group into one task; with a group holding a third of
the rows that task is the job.  ``rank_within`` instead range-partitions
by (group, order), numbers rows inside each partition from
``monotonically_increasing_id`` and adds the row counts of the earlier
partitions of the same group.  The per-(partition, group) table has at most
``partitions + groups`` rows; AQE broadcasts it when it is small (a runtime
size check) and sort-merge joins it otherwise.

The numbered rows are written once to the shared checkpoint folder before the
counts are taken (which read the key columns only): two separate range
exchanges would each sample their own boundaries, so partition ids could
disagree between the counts and the rows, and a re-run after an executor
loss must see the same numbering.  The order columns must be unique within
a group (add an id as tie-breaker).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def rank_within(df: DataFrame, group: list[str], order: list[str | Column], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row within its group by ``order``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.col(g) for g in group] + order_cols
    # The range exchange samples its input before shuffling it; what comes out of an earlier exchange is reused.
    ranged = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    gcols = ["_pid", *group]
    stats = ranged.groupBy(*gcols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # over the per-(partition, group) counts: at most partitions + groups rows, never the data
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) if group \
        else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    right = stats.select(*[F.col(c).alias(f"_s_{c}") for c in gcols], "_first", "_off")
    same = F.lit(True)
    for c in gcols:  # null is a group like any other
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    joined = ranged.join(right, same, "inner").drop(*[f"_s_{c}" for c in gcols])
    return (joined.withColumn(name, F.col("_mid") - F.col("_first") + F.col("_off") + 1)
            .drop("_pid", "_mid", "_first", "_off"))


def global_index(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """0-based stable row index in ``order`` (no global window)."""
    return rank_within(df, [], order, "_r").withColumn(name, F.col("_r") - 1).drop("_r")


def seeded_key(id_col: Column, seed: int) -> Column:
    """Seeded shuffle key, 60 bits of an md5 (order by it, then by the id; per-epoch reshuffle = seed + epoch)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def split_exact(df: DataFrame, id_col: str, frac: float = 0.9, seed: int = 42) -> DataFrame:
    """Exact split: the first floor(frac * n) rows of the seeded order are train.

    ``randomSplit`` only hits the fraction on average.  Here the last train row is *selected*, not sorted for: counts
    of key ranges narrow it down 16 bits at a time (65,536 counts on the driver at most) until a range holds few
    rows; then one filter splits the table.  Rows that tie in key and id with the last one are told apart by number.
    """
    keyed = df.withColumn("_k", seeded_key(F.col(id_col), seed))
    found = _last_of_first(keyed, id_col, frac)
    if found is None:
        return df.withColumn("split", F.lit("test"))
    key, last, taken, tied = found
    c, k = F.col(id_col), F.col("_k")
    last_id = F.lit(last).cast(dict(df.dtypes)[id_col])
    same = (k == key) & c.eqNullSafe(last_id)
    lower = c.isNull() & F.lit(last is not None) | F.coalesce(c < last_id, F.lit(False))
    name = lambda train: F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("split")
    if taken == tied:
        return keyed.select(*df.columns, name((k < key) | (k == key) & lower | same))
    number = global_index(keyed.where(same).withColumn("_n", F.monotonically_increasing_id()), ["_n"], "_i")
    return keyed.where(~same).select(*df.columns, name((k < key) | (k == key) & lower)) \
        .unionByName(number.select(*df.columns, name(F.col("_i") < taken)))


KEY_BITS, STEP_BITS, FEW = 60, 16, 10_000


def _last_of_first(keyed: DataFrame, id_col: str, frac: float) -> tuple[int, object, int, int] | None:
    """(key, id, how many rows that equal it are among the first floor(frac * n), how many there are) of the last of these."""
    shift, rank, part = KEY_BITS, None, keyed
    while True:
        step = max(shift - STEP_BITS, 0)
        counts = sorted((r["b"], r["count"]) for r in part.groupBy(F.shiftright("_k", step).alias("b")).count().collect())
        if rank is None:
            rank = int(frac * sum(n for _, n in counts))
            if rank < 1:
                return None
        for bucket, n in counts:
            if rank <= n:
                break
            rank -= n
        part, shift = keyed.where(F.shiftright("_k", step) == bucket), step
        if n <= FEW or not shift:
            break
    rows = part.groupBy("_k", id_col).count().collect()  # FEW at most, or the ids of one key
    for key, i, n in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])):
        if rank <= n:
            return key, i, rank, n
        rank -= n
    return None


# ------------------------------------------------------------------ epochs without a sort

ROUNDS = 4
MOST_WALKS = 64


def _sides(n: int) -> tuple[int, int]:
    """a, b with n <= a * b < n + a, as nearly square as can be."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, -(-n // a)


def epoch_position(idx: Column, n: int, seed: int, epoch: Column | int) -> Column:
    """Place of row ``idx`` (0..n-1) in the shuffled order of an epoch: a keyed permutation, so no epoch is sorted.

    A generalised Feistel network permutes the a x b grid of at least n cells: in turn, each coordinate is moved by a
    hash of the other one (seed, epoch and round are the key).  A row that lands on one of the fewer than a cells
    beyond n walks on until it is inside; such a walk visits different cells, so it takes a * b - n steps at most,
    and more than ``MOST_WALKS`` with odds of less than one in 10**115.
    """
    a, b = _sides(n)
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch

    def turn(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), r.cast("string"), F.when(even, x["q"]).otherwise(x["p"]).cast("string")))
        h = F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
        return F.struct(F.when(even, (x["p"] + h) % a).otherwise(x["p"]).alias("p"), F.when(even, x["q"]).otherwise((x["q"] + h) % b).alias("q"))

    def once(x: Column) -> Column:
        q = (x % b).cast("bigint")
        cell = F.struct(((x - q) / b).cast("bigint").alias("p"), q.alias("q"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cell, turn, lambda y: y["p"] * b + y["q"])
    walks = min(a * b - n, MOST_WALKS)
    place = once(idx.cast("bigint"))
    if walks:
        place = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), place, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return place


def epoch_shards(indexed: DataFrame, idx: str, n: int, world: int, seed: int, epochs: list[int]) -> DataFrame:
    """Rows of every epoch with (epoch, rank, slot): a shuffled epoch dealt to ``world`` ranks of equal length.

    The order is ``epoch_position``; it is padded by wrapping to a multiple of ``world``, and place p goes to rank
    p mod world as its slot p div world.  No sort and no shuffle: readers filter by epoch and rank.
    """
    total = -(-n // world) * world
    each = indexed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in epochs])))
    place = epoch_position(F.col(idx), n, seed, F.col("epoch"))
    each = each.withColumn("_p", F.explode(F.sequence(place, F.lit(total - 1).cast("bigint"), F.lit(max(n, 1)).cast("bigint"))))
    return each.withColumn("rank", (F.col("_p") % world).cast("int")).withColumn("slot", ((F.col("_p") - F.col("_p") % world) / world).cast("bigint")).drop("_p")
