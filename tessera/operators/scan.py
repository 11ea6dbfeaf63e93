"""Scans along a dense index within groups, without a window or a task that holds a whole group.

Rows are cut into blocks of consecutive indexes.  What one block needs of its
neighbours travels as a few rows, never as a self join:

* running sums: totals of blocks are blocked again, level by level, until one
  level fits a single block; offsets come back down the levels;
* previous rows and moving sums: the last rows of a block are copied into the
  next one (a halo), in the same exchange that forms the blocks;
* affine recurrences A(t) = a(t) + f(t) * A(t + 1): the steps of a block
  compose to one map, blocks of maps compose again; values come back down.

Null is a group like any other.  The index must be dense per group (0, 1, 2,
... or 1, 2, 3, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import null_safe_join

BLOCK = 4096
FOLD = 256  # steps of a block that one expression folds


def prefix_sums(df: DataFrame, group: list[str], idx: str, cols: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add inclusive running sums ``name`` of each expression in ``cols`` along ``idx`` within ``group``."""
    block = max(2, block)
    base = df.withColumn("_b", F.floor(F.col(idx) / block))
    for name, c in cols.items():
        base = base.withColumn(f"_v_{name}", c)
    within = Window.partitionBy(*group, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_l_{n}") for n in cols])
    totals = cut_lineage(base.groupBy(*group, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in cols]))  # rows / block of them
    before = _sums_before(totals, group, list(cols), block)
    out = local if before is None else null_safe_join(local, before, [*group, "_b"], "left")
    for name in cols:
        own = F.col(f"_l_{name}")
        out = out.withColumn(name, own if before is None else F.when(F.col(f"_o_{name}").isNull(), own).otherwise(F.col(f"_o_{name}") + own))
    return out.drop("_b", *[f"_{p}_{n}" for n in cols for p in ("v", "l", "o")])


def _sums_before(totals: DataFrame, group: list[str], names: list[str], block: int) -> DataFrame | None:
    """(group, _b, _o_name): sums of all earlier blocks of the group; none if no group has two blocks."""
    lo, hi = totals.agg(F.min("_b"), F.max("_b")).first()
    if lo is None or lo == hi:
        return None
    if hi - lo < block:  # a group's totals are one block
        before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*group, "_b", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in names])
    up = prefix_sums(totals.withColumnRenamed("_b", "_i"), group, "_i", {f"_u_{n}": F.col(f"_t_{n}") for n in names}, block)
    return up.select(*group, F.col("_i").alias("_b"), *[(F.col(f"_u_{n}") - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in names])


def moving_sums(df: DataFrame, group: list[str], idx: str, col: str, width: int, block: int = BLOCK) -> DataFrame:
    """Add ``mov_sum`` and ``mov_n``: sum / count of ``col`` over the last ``width`` rows (inclusive)."""
    if width > block:
        raise ValueError("a window must not be wider than a block")
    u = with_halo(df, idx, width - 1, block)
    w = Window.partitionBy(*group, "_b").orderBy(idx).rowsBetween(-(width - 1), 0)
    return (u.withColumn("mov_sum", F.sum(col).over(w)).withColumn("mov_n", F.count(col).over(w))
            .where(~F.col("_halo")).drop("_b", "_halo"))


def with_halo(df: DataFrame, idx: str, rows: int, block: int) -> DataFrame:
    """``df`` with its block ``_b``; the last ``rows`` rows of a block stand in the next one too, marked ``_halo``."""
    b = F.floor(F.col(idx) / block)
    late = F.col(idx) - b * block >= block - rows
    both = F.explode(F.when(late, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    return df.withColumn("_halo", both).withColumn("_b", b + F.col("_halo").cast("int"))


def with_previous(df: DataFrame, group: list[str], idx: str, cols: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Add ``cols[name]``, the value of ``name`` in the row before (null for a group's first)."""
    w = Window.partitionBy(*group, "_b").orderBy(idx)
    u = with_halo(df, idx, 1, block)
    return u.select("*", *[F.lag(c).over(w).alias(new) for c, new in cols.items()]).where(~F.col("_halo")).drop("_b", "_halo")


def fold_back(steps: DataFrame, group: list[str], idx: str, step: Callable[[Column, Column], tuple[Column, Column]], cols: list[str],
              after: DataFrame | None = None, out: str = "value", block: int = FOLD, keep: list[str] | None = None) -> DataFrame:
    """(group, idx, keep, out): A(t) = a(t) + f(t) * A(t + 1), with A = 0 behind a group's last step.

    ``step(row, next_row)`` gives the expressions (a, f) from the columns ``cols`` of a step and of the step behind it;
    behind the last step stands the row of ``after`` (group, cols), or a null one.
    """
    block = max(2, block)
    b = F.floor(F.col(idx) / block)
    first = (F.col(idx) == b * block) & (F.col(idx) > 0)  # a block's first step is the step behind the block before
    both = F.explode(F.when(first, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = steps.select(*group, idx, *cols).withColumn("_halo", both).withColumn("_b", b - F.col("_halo").cast("int"))
    each = F.struct(F.col(idx).alias("t"), *cols)
    blocks = rows.groupBy(*group, "_b").agg(F.sort_array(F.collect_list(F.when(~F.col("_halo"), each)), asc=False).alias("steps"),
                                            F.max(F.when(F.col("_halo"), F.struct(*cols))).alias("behind"))
    if after is not None:
        blocks = null_safe_join(blocks, after.select(*group, F.struct(*cols).alias("_after")), group, "left") \
            .withColumn("behind", F.coalesce("behind", "_after")).drop("_after")
    kinds = {c: t for c, t in steps.dtypes}
    blocks = cut_lineage(blocks)
    row = f"struct<{', '.join(f'{c}: {kinds[c]}' for c in cols)}>"
    plain = lambda e: F.struct(*[e[c].alias(c) for c in cols]).cast(row)
    start = F.coalesce(F.col("behind"), F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in cols])).cast(row)

    def compose(acc: Column, e: Column) -> Column:
        a, f = step(e, acc["row"])
        return F.struct((a + f * acc["a"]).cast("double").alias("a"), (f * acc["f"]).cast("double").alias("f"), plain(e).alias("row"))
    whole = F.aggregate("steps", F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("f"), start.alias("row")), compose)
    maps = blocks.select(*group, "_b", whole.alias("m")).select(*group, "_b", F.col("m.a").alias("a"), F.col("m.f").alias("f"))
    behind = _values_behind(maps, group, block)
    if behind is not None:
        blocks = null_safe_join(blocks, behind, [*group, "_b"], "left")
    value = F.coalesce(F.col("_behind"), F.lit(0.0)) if behind is not None else F.lit(0.0)
    keep = keep or []
    item = f"struct<{', '.join(['t: ' + kinds[idx], *(f'{c}: {kinds[c]}' for c in keep), 'value: double'])}>"

    def apply(acc: Column, e: Column) -> Column:
        a, f = step(e, acc["row"])
        v = (a + f * acc["value"]).cast("double")
        return F.struct(v.alias("value"), plain(e).alias("row"), F.concat(acc["out"], F.array(F.struct(e["t"].alias("t"), *[e[c].alias(c) for c in keep], v.alias("value")))).alias("out"))
    done = F.aggregate("steps", F.struct(value.alias("value"), start.alias("row"), F.array().cast(f"array<{item}>").alias("out")), apply, lambda acc: acc["out"])
    return blocks.select(*group, F.explode(done).alias("_r")).select(*group, F.col("_r.t").alias(idx), *[F.col(f"_r.{c}").alias(c) for c in keep], F.col("_r.value").alias(out))


def _values_behind(maps: DataFrame, group: list[str], block: int) -> DataFrame | None:
    """(group, _b, _behind): A at the first step of the next block, from the blocks' maps; none if no group has two blocks."""
    maps = cut_lineage(maps)
    lo, hi = maps.agg(F.min("_b"), F.max("_b")).first()
    if lo is None or lo == hi:
        return None
    value = fold_back(maps.withColumnRenamed("_b", "_i"), group, "_i", lambda e, _: (e["a"], e["f"]), ["a", "f"], out="_behind", block=block)
    return value.select(*group, (F.col("_i") - 1).alias("_b"), "_behind")
