"""Operator 10: secret scan with corpus-wide ownership frequency.

One pass over the texts finds candidate spans by pattern (base spans) and a
hash of each candidate's value.  The hashes alone are aggregated: first to
distinct (hash, owner, repository), then per hash to the number of owners
and repositories.  A value that many owners hold is a widely copied example;
one that a single owner holds and that looks random is taken as a live
credential, and its value gets a further span of kind ``live``.  Base spans
stay whatever the frequency says.

Values never leave a task in clear.  A value that a third of all documents
hold is one row per task after the partial distinct; the join of statuses
back to spans is an equi-join that adaptive execution can split.

Edge cases: a null text is empty; a null owner is an owner of its own;
repeated rows count once per repository; documents without candidates give a
row with zero counts and the digest of the empty string; an empty table gives
no rows; null or repeated doc_ids are rows like others; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free, quoted, stored
from .worker import tidy

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# a run that is long enough is the whole base match, as the classes have no gaps
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
EXAMPLE_OWNERS = 3
MIN_LIVE_BITS = 3.0  # entropy per character
PLACEHOLDERS = re.compile(r"example|changeme|placeholder|your|dummy|sample|xxxx|1234567", re.IGNORECASE)

_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("vstart", pa.int64()), ("vend", pa.int64()),
                   ("hash", pa.string()), ("looks_live", pa.bool_())])
_SPAN_SQL = "array<struct<start:long,kind:int,end:long,vstart:long,vend:long,hash:string,looks_live:boolean>>"


def looks_live(value: str) -> bool:
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= MIN_LIVE_BITS and not PLACEHOLDERS.search(value)


def base_spans(text: str) -> list[dict]:
    """Base spans of a text, by start, then kind as listed; offsets in code points, end exclusive."""
    found = [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    out = []
    for start, kind, end, a, b in sorted(found):
        value = text[a:b]
        out.append({"start": start, "kind": kind, "end": end, "vstart": a, "vend": b,
                    "hash": hashlib.sha256(value.encode()).hexdigest()[:32], "looks_live": looks_live(value)})
    return out


def spans_text(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)


def may_match(text: Column) -> Column:
    """True wherever a base pattern can match: plain substring tests that let most texts pass by."""
    low = F.lower(text)
    words = [F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    some = F.contains(text, F.lit("AKIA")) | text.rlike("[0-9a-f]{24}")
    for w in words:
        some = some | w
    return F.coalesce(some, F.lit(False))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(row, doc_id, text_key, owner, repository, spans, base_sha256): base spans of every row, written once."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("owner", pa.string()), ("repository", pa.string()),
                        ("spans", pa.list_(_SPAN)), ("base_sha256", pa.string())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            n = b.num_rows
            spans = [base_spans(t.as_py() or "") for t in b.column(4)]
            sha = [hashlib.sha256(spans_text(s).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), *(b.column(k).cast(schema.field(k + 1).type) for k in range(4)),
                                              pa.array(spans, schema.field("spans").type), pa.array(sha)], schema=schema)
            row += n
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col(owner).cast("string").alias("owner"),
                       F.col(repository).cast("string").alias("repository"), F.when(may_match(F.col("text").cast("string")), F.col("text").cast("string")).alias("text"))
    return stored(cols.mapInArrow(run, f"row long, doc_id long, text_key long, owner string, repository string, spans {_SPAN_SQL}, base_sha256 string"), "secret-spans")


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(hash, owners, repositories, status) of every candidate value; status is example, live or unclear."""
    c = found.select("owner", "repository", F.explode("spans").alias("s")).select("s.hash", "owner", "repository", "s.looks_live").distinct()
    by_owner = c.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("looks_live").alias("looks_live"))
    by_hash = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), F.max("looks_live").alias("looks_live"))
    status = (F.when(F.col("owners") >= example_owners, "example")
              .when((F.col("owners") == 1) & F.col("looks_live"), "live").otherwise("unclear"))
    return by_hash.select("hash", "owners", "repositories", status.alias("status"))


def with_status(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per span: (row, doc_id, text_key, span fields, owners, repositories, status)."""
    each = found.select("row", "doc_id", "text_key", F.explode("spans").alias("s")).select("row", "doc_id", "text_key", "s.*")
    return each.join(ownership(found, example_owners), "hash", "left")


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_live, base_sha256, spans) of every row."""
    found = scan(docs, owner, repository)
    live = (with_status(found, example_owners).where(F.col("status") == "live")
            .groupBy("row").agg(F.collect_list(F.struct(F.col("vstart").alias("start"), F.lit(3).alias("kind"), F.col("vend").alias("end"))).alias("live")))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    # two patterns may cover one value (assign and hex): one live span
    every = F.sort_array(F.concat(base, F.array_distinct(F.coalesce(F.col("live"), none))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return (found.join(live, "row", "left")
            .select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.size(F.array_distinct(F.coalesce(F.col("live"), none))).cast("long").alias("n_live"), "base_sha256", text.alias("spans")))


def merged(spans: Column) -> Column:
    """Sorted spans (start, end) with overlapping ones joined."""
    kind = "array<struct<start:long,end:long>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        new = F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.when(F.size(acc) == 0, new).when(x["start"] <= last["end"], joined).otherwise(new).cast(kind)
    return F.aggregate(F.sort_array(spans), F.array().cast(kind), step)


def redact(docs: DataFrame, mark: str = "[secret]", owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with the values of all candidates but widely copied examples replaced by ``mark``; n_chars follows.

    No row is dropped.  Rows are matched by (doc_id, hash of the text), so
    repeated rows and null doc_ids are redacted alike.
    """
    found = scan(docs, owner, repository)
    d, k, c = free(docs.columns, "redact_doc", "redact_key", "redact_cut")
    cut = (with_status(found, example_owners).where(F.col("status") != "example")
           .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(F.col("vstart").alias("start"), F.col("vend").alias("end"))).alias("s"))
           .select(F.col("doc_id").alias(d), F.col("text_key").alias(k), merged(F.col("s")).alias(c)))
    some = may_match(F.col("text"))
    hit = docs.where(some).join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k)), "left")
    n = F.size(c)
    begin = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col(c), i - 1)["end"])
    end = lambda i: F.when(i == n, F.length("text").cast("long")).otherwise(F.get(F.col(c), i)["start"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substr(F.col("text"), (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int")))
    text = F.when(F.col(c).isNull(), F.col("text")).otherwise(F.array_join(pieces, mark))
    out = {x: F.col(quoted(x)) for x in docs.columns}
    out["text"] = text
    if "n_chars" in out:
        gone = F.aggregate(F.col(c), F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
        size = F.length("text") - gone + F.size(c) * len(mark)
        out["n_chars"] = F.when(F.col(c).isNull(), F.col("n_chars")).otherwise(size).cast(docs.schema["n_chars"].dataType)
    # a text that no pattern can match is not shuffled
    return hit.select(*[x.alias(name) for name, x in out.items()]).unionByName(docs.where(~some))
