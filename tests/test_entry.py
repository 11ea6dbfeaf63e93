"""Driver contract: entry() and every registered job run on the smallest tables."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["level", "rule", "field", "n_issues", "n_records"]


def test_every_job_has_an_oracle_or_is_listed_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    rows_only = set(q) - set(o)
    # models, fingerprints, files and edit distances: tests/llm holds them against brute force
    llm = {n for n in rows_only if n == "pipeline" or n.startswith("op")}
    assert rows_only == llm


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_job_runs(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
