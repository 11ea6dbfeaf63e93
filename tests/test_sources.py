"""Corpus sources and sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import io

SCHEMA = "instruction string, output string"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_jsonl_blank_lines_and_one_line_array(spark, tmp_dir):
    write(f"{tmp_dir}/a.jsonl", '{"instruction": "a", "output": "1"}\n\n{"instruction": "b", "output": "2"}\n')
    write(f"{tmp_dir}/b.json", json.dumps([{"instruction": "c", "output": "3"}, {"instruction": "d", "output": "4"}]))
    df = io.read_corpus(spark, [f"{tmp_dir}/a.jsonl", f"{tmp_dir}/b.json"], SCHEMA)
    assert sorted(r.instruction for r in df.collect()) == ["a", "b", "c", "d"]


def test_broken_line_is_fatal_when_strict(spark, tmp_dir):
    write(f"{tmp_dir}/bad.jsonl", '{"instruction": "a", "output": "1"}\n{broken\n')
    with pytest.raises(Exception):
        io.read_corpus(spark, f"{tmp_dir}/bad.jsonl", SCHEMA).collect()


def test_sniff_and_read_nested_dir_with_pretty_array(spark, tmp_dir):
    write(f"{tmp_dir}/root/x/lines.jsonl", '{"instruction": "a", "output": "1"}\n')
    write(f"{tmp_dir}/root/y/z/pretty.json",
          json.dumps([{"instruction": "b", "output": "2"}, {"instruction": "c", "output": "3"}], indent=2))
    write(f"{tmp_dir}/root/notes.txt", "ignored")
    write(f"{tmp_dir}/root/empty.jsonl", "")
    fmts = {os.path.basename(r.file_path): r.format for r in io.sniff_formats(spark, f"{tmp_dir}/root").collect()}
    assert fmts == {"lines.jsonl": "lines", "pretty.json": "array"}
    df = io.read_any(spark, f"{tmp_dir}/root", SCHEMA)
    assert sorted(r.instruction for r in df.collect()) == ["a", "b", "c"]


def test_empty_input_is_an_error(spark, tmp_dir):
    write(f"{tmp_dir}/e/empty.jsonl", "\n")
    with pytest.raises(io.EmptyInput):
        io.require_rows(io.read_corpus(spark, f"{tmp_dir}/e/empty.jsonl", SCHEMA))


def test_row_index_in_file_order(spark, tmp_dir):
    write(f"{tmp_dir}/i/a.jsonl", "".join(json.dumps({"instruction": str(k), "output": ""}) + "\n" for k in range(50)))
    df = io.with_row_index(io.read_corpus(spark, f"{tmp_dir}/i/a.jsonl", SCHEMA))
    assert [r.instruction for r in df.orderBy("idx").collect()] == [str(k) for k in range(50)]


def test_jsonl_sink_keeps_nulls_and_unicode(spark, tmp_dir):
    df = spark.createDataFrame([("中文", None)], SCHEMA)
    io.write_jsonl(df, f"{tmp_dir}/out")
    text = "".join(open(os.path.join(f"{tmp_dir}/out", f), encoding="utf-8").read()
                   for f in os.listdir(f"{tmp_dir}/out") if f.endswith(".json"))
    assert '"output":null' in text and "中文" in text


def test_features_csv(spark, tmp_dir):
    write(f"{tmp_dir}/f.csv", "a,b,label\n0.5,1.5,1\n2,3,0\n")
    rows = io.read_features_csv(spark, f"{tmp_dir}/f.csv", 2).collect()
    assert rows[0].features == [0.5, 1.5] and rows[1].label == 0.0


def test_blank_lines_are_no_records(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/b")
    for name, text in (("a.jsonl", '{"x":1}\n\n  \n{"x":2}\n'), ("b.jsonl", '\n{"x":3}')):
        with open(f"{tmp_dir}/b/{name}", "w") as f:
            f.write(text)
    got = sorted((r.idx, r.raw) for r in io.read_records(spark, f"{tmp_dir}/b").collect())
    assert got == [(0, '{"x":1}'), (1, '{"x":2}'), (2, '{"x":3}')]


def test_index_follows_files_and_splits(spark, tmp_dir):
    spark.range(5000).selectExpr("concat('{\"x\":', id, '}') as value").repartition(3).write.text(f"{tmp_dir}/t")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = io.with_row_index(spark.read.text(f"{tmp_dir}/t").withColumn("f", F.col("_metadata.file_name"))).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    import glob
    want = [line.rstrip("\n") for p in sorted(glob.glob(f"{tmp_dir}/t/*.txt")) for line in open(p)]
    assert [r.idx for r in rows] == list(range(5000)) and [r.value for r in rows] == want


def test_array_sink_round_trip(spark, tmp_dir):
    rows = [(1, 'a "quoted", [b]\n'), (2, None), (3, "\u00e9\u65e5\\")]
    df = spark.createDataFrame(rows, "x long, s string")
    io.write_json_array(df.repartition(2), f"{tmp_dir}/arr")
    io.write_json_array(df.where("x > 9"), f"{tmp_dir}/none")
    assert sorted(tuple(r) for r in io.read_corpus(spark, f"{tmp_dir}/arr", "x long, s string", multiline=True).collect()) == rows
    assert io.read_corpus(spark, f"{tmp_dir}/none", "x long, s string", multiline=True).count() == 0


def test_one_array_file_is_read_by_many_tasks(spark, tmp_dir):
    import json
    import random
    rng = random.Random(4)
    parts = ["}", "{", "]", "[", ",", '"', "\\", "\\\\", "é", "日本", " ", "\n", "a", "}{", '"}', "\\\""]
    rows = [{"x": k, "s": "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) if k % 7 else None, "o": {"k": [k, {"z": "}"}]} if k % 3 else None}
            for k in range(900)]
    os.makedirs(f"{tmp_dir}/arr")
    for name, some, indent in (("a", rows[:600], None), ("b", rows[600:], 2)):
        with open(f"{tmp_dir}/arr/{name}.json", "w", encoding="utf-8") as f:
            json.dump(some, f, indent=indent, ensure_ascii=False)
    with open(f"{tmp_dir}/arr/c.json", "w") as f:
        f.write(" [ ] \n")
    kind = "x long, s string, o struct<k: array<string>>"
    want = sorted((r.x, r.s) for r in io.read_corpus(spark, f"{tmp_dir}/arr", kind, multiline=True).collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = io.read_arrays(spark, f"{tmp_dir}/arr", kind)
        assert spark.read.option("lineSep", "}").text(f"{tmp_dir}/arr").rdd.getNumPartitions() > 10
        got = back.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.x, r.s) for r in got) == want == [(r["x"], r["s"]) for r in rows]
    assert {r.file_path.rsplit("/", 1)[1] for r in got} == {"a.json", "b.json"}
    assert all((r.o is None) == (r.x % 3 == 0) and (r.o is None or len(r.o.k) == 2) for r in got)


def test_quotes_and_depths_of_both_cases():
    assert io._quotes_and_depths('[{"a": "x{"') == (4, 2, 1)
    assert io._quotes_and_depths('\\" {') == (0, 1, 0)
    assert io._quotes_and_depths('} ", [') == (1, -1, 1)
