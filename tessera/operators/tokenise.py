"""Word tokenisation, prompt masking and padding reports.

Model-specific BPE is out of scope; tokens are whitespace words and ids come
from a vocabulary of all words, or the V most frequent ones (ties by text),
built by Spark; ids 0 and 1 are PAD and UNK.

The lookup is a dictionary join in two phases.  A task numbers the distinct
words of a *chunk* of texts locally and writes, once, the texts as local
numbers and the words with theirs.  Only these distinct words meet the
vocabulary (an equi-join); their ids come back to the chunk as one array, by
local number.  So no token crosses the network, and a word that stands in a
third of all places is one row a chunk.

Splitting runs in Arrow batches: ``str.split()`` is the definition of these
tokens, and counting or numbering them leaves the task as numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import rank_within

PAD_ID, UNK_ID, IGNORE = 0, 1, -100
CHUNK_WORDS = 1 << 16  # distinct words of a chunk, over which a new one begins


def token_counts(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, n_tokens): number of whitespace tokens of every row's text; no text leaves its task."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=[*b.schema.names[:-1], "n_tokens"])
    return df.select(*keys, text.alias("_text")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_tokens int"]))


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """(token, n) of all whitespace tokens, counted per task before the aggregation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["token", "n"])
            held.clear()
            return out
        for b in batches:
            for t in b.column(0):
                held.update((t.as_py() or "").split())
                if len(held) > CHUNK_WORDS:
                    yield flush()
        if held:
            yield flush()
    return texts.select(F.col(col).cast("string")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def build_vocab(texts: DataFrame, col: str, size: int | None = None) -> DataFrame:
    """(token, id): all whitespace tokens, or the ``size`` most frequent ones, ids from 2 in frequency order."""
    counts = word_counts(texts, col)
    if size is None:  # numbered without a window over the whole vocabulary
        counts = cut_lineage(counts)  # a range exchange samples its input first
        return rank_within(counts, [], [F.col("n").desc(), F.col("token")], "_r").select("token", (F.col("_r") + 1).cast("int").alias("id"))
    top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(size)  # bounded: a top-k is the feature
    # a window without partition is fine here: it numbers the at most ``size`` rows of the top-k
    return top.select("token", (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("token"))) + 1)
                      .alias("id"))


def numbered_words(df: DataFrame, key: str, prompt: Column, full: Column, max_len: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows (chunk, key, n_prompt, n_tokens, local) of texts and rows (chunk, words) of the words behind local numbers."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        chunk, number = TaskContext.get().partitionId() << 32, {}

        def words() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, types[1]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()),
                                               pa.nulls(1, pa.list_(pa.int32())), pa.array([list(number)], pa.list_(pa.string()))], names)
        names = ["chunk", "key", "n_prompt", "n_tokens", "local", "words"]
        types: list[pa.DataType] = []
        for b in batches:
            types = [pa.int64(), b.column(0).type]
            rows: list[tuple] = []
            for k, p, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                tokens = (t.as_py() or "").split()
                rows.append((chunk, k, len((p.as_py() or "").split()), len(tokens), [number.setdefault(w, len(number)) for w in tokens[:max_len]]))
                if len(number) >= chunk_words:
                    yield texts(rows, types, names)
                    yield words()
                    rows, number, chunk = [], {}, chunk + 1
            if rows:
                yield texts(rows, types, names)
        if number:
            yield words()

    def texts(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], types[1]), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()),
                                           pa.array(c[4], pa.list_(pa.int32())), pa.nulls(len(rows), pa.list_(pa.string()))], names)
    return df.select(F.col(key).alias("key"), F.coalesce(prompt, F.lit("")).alias("p"), F.coalesce(full, F.lit("")).alias("f")) \
        .mapInArrow(run, f"chunk long, key {kind}, n_prompt int, n_tokens int, local array<int>, words array<string>")


def with_token_ids(numbered: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, n_prompt, n_tokens, ids) of ``numbered_words``: each chunk's distinct words looked up once, UNK if unknown."""
    table = cut_lineage(numbered)
    each = table.where("words is not null").select("chunk", F.posexplode("words").alias("no", "token"))
    found = each.join(vocab, "token", "left").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("no", F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("id")))).alias("d"))  # a chunk's words
    rows = table.where("words is null").join(found.select("chunk", F.col("d.id").alias("d")), "chunk", "left")
    return rows.select("key", "n_prompt", "n_tokens", F.transform("local", lambda i: F.get(F.col("d"), i)).alias("ids"))


def masked_labels(ids: Column, n_prompt: Column, max_len: int) -> Column:
    """P10: labels = ids with the first min(prompt, max_len) positions set to -100, truncated to max_len."""
    return F.transform(F.slice(ids, 1, max_len), lambda x, i: F.when(i < n_prompt, F.lit(IGNORE)).otherwise(x))


def tokenise_masked(df: DataFrame, key: str, prompt: Column, full: Column, vocab: DataFrame,
                    max_len: int) -> DataFrame:
    """P10 + P11: (key, n_prompt, n_tokens, input_ids, labels, trainable_tokens, fully_masked).

    n_tokens is the length of the whole text before truncation to max_len.
    """
    ids = with_token_ids(numbered_words(df, key, prompt, full, max_len), vocab).withColumnRenamed("key", key)
    out = ids.select(key, "n_prompt", "n_tokens", F.col("ids").alias("input_ids"), masked_labels(F.col("ids"), F.col("n_prompt"), max_len).alias("labels"))
    trainable = F.size(F.filter("labels", lambda x: x != IGNORE))
    return out.withColumn("trainable_tokens", trainable).withColumn("fully_masked", trainable == 0)


def padding_report(lengths: DataFrame, batch: Column, length: str, group: list[str] | None = None) -> DataFrame:
    """Pad every batch to its longest sequence; report real, padded and wasted tokens.

    lengths: one row per sequence with its batch number (floor(index / B)).
    Left padding (RL prompts) and right padding (SFT) waste the same count.
    """
    g = group or []
    per_batch = lengths.groupBy(*g, batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_real"), F.max(length).alias("_max"))
    return per_batch.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("_real").alias("real_tokens"),
        F.sum(F.col("_n") * F.col("_max")).alias("padded_tokens"),
        (1 - F.sum("_real") / F.sum(F.col("_n") * F.col("_max"))).alias("waste_ratio"))
