"""Equi-joins in which null is a key value like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``<=>`` of ``keys``; the key columns of ``left`` are kept.

    Spark plans ``<=>`` as an equi-join, so the strategies are those of a plain join.
    """
    names = {k: f"_join_{k}" for k in keys}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same: Column = F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return left.join(renamed, same, how).drop(*names.values())
