"""Helpers shared by the registered jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Round a double for reporting: round(x * 1e6) / 1e6, half away from zero.

    This is the same arithmetic DuckDB's round(x, 6) does, so binary near-ties
    (104.9376295 is stored as ...29499...) round alike in job and oracle.
    """
    return F.round(c * F.lit(1e6)) / F.lit(1e6)
