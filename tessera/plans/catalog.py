"""Registered jobs: name -> (spark job over the driver's tables, DuckDB oracle SQL).

Every job reads whole tables (or data Spark derives from them).  Doubles are
rounded to 6 places on both sides so that summation order does not change
the value hash; counts are bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registries
    from . import (q_files, q_generate, q_lint, q_metrics, q_render, q_rl, q_runlog,  # noqa: F401
                   q_score, q_tokenise)
    q_files.register_results()
