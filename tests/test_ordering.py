"""Stable ranks without a global window, under a hot group."""

from pyspark.sql import functions as F

from tessera.operators import ordering as O


def test_rank_within_skewed_group(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 50}", 10_000 + i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v long")
    out = O.rank_within(df, ["g"], ["v"], "rk", partitions=16).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.v, r.rk))
    for g, vals in by.items():
        vals.sort()
        assert [rk for _, rk in vals] == list(range(1, len(vals) + 1)), g


def test_global_index_dense_and_descending(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "v")
    idx = O.global_index(df, [F.col("v").desc()], "i").collect()
    assert sorted((r.i, -r.v) for r in idx) == [(i, -(999 - i)) for i in range(1000)]


def test_split_exact(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "doc_id")
    s = O.split_exact(df, "doc_id", 0.9, seed=3)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 90, "test": 11}
    again = {r.doc_id for r in O.split_exact(df, "doc_id", 0.9, seed=3).where("split = 'test'").collect()}
    assert again == {r.doc_id for r in s.where("split = 'test'").collect()}


def test_rank_keeps_rows_with_a_null_group(spark):
    from tessera.operators import ordering as O
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 1), ("b", 5)], "g string, o int")
    got = sorted((str(r.g), r.o, r.rank) for r in O.rank_within(df, ["g"], ["o"]).collect())
    assert got == [("None", 1, 1), ("None", 3, 2), ("a", 1, 1), ("a", 2, 2), ("b", 5, 1)]


def test_group_advantage_keeps_rows_with_a_null_group(spark):
    from tessera.operators import rl
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, reward double")
    got = sorted((str(r.g), round(r.advantage, 6)) for r in rl.group_advantage(df, ["g"]).collect())
    assert got == [("None", -0.707107), ("None", 0.707107), ("a", 0.0)]


def test_split_exact_ties_nulls_and_bounds(spark):
    rows = [(None,)] * 7 + [(5,)] * 9 + [(k,) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long").selectExpr("doc_id", "1 as other")
    for frac in (0.0, 0.01, 0.1, 0.33, 0.5, 0.77, 0.9, 1.0):
        got = {r.split: r["count"] for r in O.split_exact(df, "doc_id", frac, seed=5).groupBy("split").count().collect()}
        n = int(frac * len(rows))
        assert got == {k: v for k, v in (("train", n), ("test", len(rows) - n)) if v}
    assert O.split_exact(df.where("false"), "doc_id").count() == 0


def test_split_exact_narrows_down_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(O, "FEW", 1)
    monkeypatch.setattr(O, "STEP_BITS", 3)
    df = spark.range(0, 997).withColumnRenamed("id", "doc_id")
    keys = sorted((r.k, r.doc_id) for r in df.select("doc_id", O.seeded_key(F.col("doc_id"), 3).alias("k")).collect())
    out = O.split_exact(df, "doc_id", 0.7, seed=3)
    assert {r.doc_id for r in out.where("split = 'train'").collect()} == {i for _, i in keys[:697]}
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()


def test_epochs_are_permutations(spark):
    for n in (1, 2, 3, 5, 16, 17, 30, 101, 1000):
        rows = spark.range(n).select(*[O.epoch_position(F.col("id"), n, 7, e).alias(f"e{e}") for e in (0, 1)]).collect()
        for e in (0, 1):
            assert sorted(r[f"e{e}"] for r in rows) == list(range(n)), (n, e)
    assert [r.e0 for r in rows] != [r.e1 for r in rows] and [r.e0 for r in rows] != list(range(1000))


def test_shards_pad_by_wrapping(spark):
    for n, world in ((10, 4), (3, 8), (8, 4), (1, 3)):
        df = spark.range(n).withColumnRenamed("id", "idx")
        out = O.epoch_shards(df, "idx", n, world, 1, [5]).collect()
        order = {r.slot * world + r.rank: r.idx for r in out}
        total = -(-n // world) * world
        assert len(out) == total and sorted(order) == list(range(total))
        assert all(order[p] == order[p % n] for p in order) and sorted(order[p] for p in range(n)) == list(range(n))
    assert "Exchange" not in O.epoch_shards(df, "idx", 1, 3, 1, [5])._jdf.queryExecution().executedPlan().toString()
