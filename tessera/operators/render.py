"""Corpus normalisation and prompt rendering.

All of these are projections: column expressions over one record, so they
run inside whole-stage codegen with no shuffle.  ``render`` arguments let a
caller plug any ``Column -> Column`` template in place of ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# ---- fixed values (must equal the reference's) ----
DEFAULT_SYSTEM = "你是物理推理助手，请展示详细的推导过程。"
PLACEHOLDER = "{instruction}"
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
HEADING_Q = "### 问题:\n"
HEADING_A = "\n\n### 回答:\n"
FALLBACK_USER = "User: "
FALLBACK_ASSISTANT = "\n\nAssistant: "
FALLBACK_TURN_END = "\n\n"
NAN_SENTINEL = -999999.0
# ---------------------------------------------------

def prefix_from_base64(b64: str) -> Column:
    """A prompt prefix passed as base64 (decoded by Spark, UTF-8)."""
    return F.decode(F.unbase64(F.lit(b64)), "UTF-8")


def user_content(instruction: Column, extra_input: Column, prefix: Column | str | None = None) -> Column:
    """Prefix substitution, then ``"\\n" + input`` when input is non-empty.

    A prefix without the placeholder *replaces* the instruction (kept as in
    the reference, Q6).
    """
    ins = F.coalesce(instruction, F.lit(""))
    if prefix is not None:
        p = F.lit(prefix) if isinstance(prefix, str) else prefix
        ins = F.replace(p, F.lit(PLACEHOLDER), ins)
    inp = F.coalesce(extra_input, F.lit(""))
    return F.when(inp != "", F.concat(ins, F.lit("\n"), inp)).otherwise(ins)


def fallback_chat_text(messages: Column) -> Column:
    """``User: ...\\n\\nAssistant: `` / ``...\\n\\n`` per turn; other roles drop out."""
    return F.array_join(F.transform(messages, lambda m: fallback_piece(m["role"], m["content"])), "")


def chatml_messages(messages: Column, add_generation_prompt: bool = False) -> Column:
    """ChatML of a message list, system turn included."""
    body = F.array_join(F.transform(messages, lambda m: chatml_piece(m["role"], m["content"])), "")
    return F.concat(body, F.lit(IM_START + "assistant\n")) if add_generation_prompt else body


def chatml_alpaca_with_system(instruction: Column, extra_input: Column, output: Column) -> Column:
    """P4 (Alpaca form): instruction as system turn, input as user turn; prompt and full text."""
    prompt = F.concat(F.lit(IM_START + "system\n"), instruction, F.lit(IM_END + "\n" + IM_START + "user\n"),
                      extra_input, F.lit(IM_END + "\n" + IM_START + "assistant\n"))
    return F.struct(prompt.alias("prompt"), F.concat(prompt, output, F.lit(IM_END)).alias("text"))


def chatml_alpaca(instruction: Column, extra_input: Column, output: Column) -> Column:
    """P5: ChatML without system turn; input appended to the instruction when non-empty."""
    inp = F.coalesce(extra_input, F.lit(""))
    user = F.when(inp != "", F.concat(instruction, F.lit("\n"), inp)).otherwise(instruction)
    return F.concat(F.lit(IM_START + "user\n"), user, F.lit(IM_END + "\n" + IM_START + "assistant\n"),
                    output, F.lit(IM_END))


def heading_template(instruction: Column, output: Column) -> Column:
    """``### 问题:`` / ``### 回答:`` template."""
    return F.concat(F.lit(HEADING_Q), instruction, F.lit(HEADING_A), output)


def rl_prompt(messages: Column | None, instruction: Column | None) -> Column:
    """System + user turns of a chat record, else system + instruction, else null (dropped)."""
    from_msgs = F.filter(messages, lambda m: m["role"].isin("system", "user")) if messages is not None else None
    from_ins = (F.array(F.struct(F.lit("system").alias("role"), F.lit(DEFAULT_SYSTEM).alias("content")),
                        F.struct(F.lit("user").alias("role"), instruction.alias("content")))
                if instruction is not None else None)
    if from_msgs is not None and from_ins is not None:
        return F.when(messages.isNotNull(), from_msgs).when(instruction.isNotNull(), from_ins)
    return from_msgs if from_msgs is not None else from_ins


def rl_prompts(df: DataFrame, messages: str | None = "messages", instruction: str | None = None) -> DataFrame:
    p = rl_prompt(F.col(messages) if messages else None, F.col(instruction) if instruction else None)
    return df.withColumn("prompt", p).where(F.col("prompt").isNotNull())


def alpaca_pair_messages(prompt_text: Column, answer: Column) -> Column:
    """P8 helper: default system + user turn + assistant answer."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(DEFAULT_SYSTEM).alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt_text.alias("content")),
                   F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def preference_pairs_alpaca(df: DataFrame, instruction: str = "instruction", prompt: str = "prompt",
                            chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """P8 (Alpaca form) + F2: pairs needing both sides; user turn is instruction, else prompt."""
    cols = df.columns
    ins = F.col(instruction) if instruction in cols else F.lit(None).cast("string")
    pr = F.col(prompt) if prompt in cols else F.lit(None).cast("string")
    user = F.coalesce(ins, pr, F.lit(""))
    return (df.where(both_sides(F.col(chosen), F.col(rejected)))
            .withColumn("chosen_messages", alpaca_pair_messages(user, F.col(chosen)))
            .withColumn("rejected_messages", alpaca_pair_messages(user, F.col(rejected))))


MESSAGES = "array<struct<role:string,content:string>>"


def preference_pairs(df: DataFrame, instruction: str = "instruction", prompt: str = "prompt",
                     chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """P8 + F2 for either form: ``chosen_messages`` and ``rejected_messages`` of rows with both sides.

    The form of a row is that of its chosen side: a message list passes through as it is, a text gains
    the default system and user turns.  The columns may be message arrays, strings, or VARIANT (a JSON
    corpus that mixes both forms); a JSON null counts as a missing side.
    """
    from pyspark.sql import types as T_
    kind = df.schema[chosen].dataType
    if isinstance(kind, T_.ArrayType):
        return (df.where(both_sides(F.col(chosen), F.col(rejected)))
                .withColumn("chosen_messages", F.col(chosen)).withColumn("rejected_messages", F.col(rejected)))
    if not isinstance(kind, T_.VariantType):
        return preference_pairs_alpaca(df, instruction, prompt, chosen, rejected)
    cols = df.columns
    text = lambda name: F.col(name).cast("string") if name in cols else F.lit(None).cast("string")
    user = F.coalesce(text(instruction), text(prompt), F.lit(""))
    # the cast yields null unless the value is a list of objects
    listed = F.try_variant_get(F.col(chosen), "$", MESSAGES).isNotNull()
    side = lambda name: F.when(listed, F.try_variant_get(F.col(name), "$", MESSAGES)).otherwise(
        alpaca_pair_messages(user, F.try_variant_get(F.col(name), "$", "string")))
    there = lambda name: F.col(name).isNotNull() & ~F.is_variant_null(F.col(name))
    return (df.where(there(chosen) & there(rejected))
            .withColumn("chosen_messages", side(chosen)).withColumn("rejected_messages", side(rejected)))


def both_sides(chosen: Column, rejected: Column) -> Column:
    """a pair needs both sides."""
    return chosen.isNotNull() & rejected.isNotNull()


def scored_texts(prompt: Column, chosen: Column, rejected: Column, end: str = IM_END) -> Column:
    """The two texts a pairwise reward model scores."""
    return F.struct(F.concat(prompt, chosen, F.lit(end)).alias("chosen_text"),
                    F.concat(prompt, rejected, F.lit(end)).alias("rejected_text"))


def reply_after_assistant(full: Column) -> Column:
    """Model reply after the first ``assistant\\n``; whole text when absent."""
    pos = F.instr(full, "assistant\n")
    return F.when(pos > 0, T.strip(full.substr(pos + F.lit(len("assistant\n")), F.lit(1 << 30)))) \
        .otherwise(T.strip(full))


def reply_after_last(full: Column, marker: str) -> Column:
    """Text after the last marker; the whole text when the marker is absent (Q8 fixed)."""
    return T.strip(F.element_at(F.split(full, _quote(marker)), -1))


def _quote(s: str) -> str:
    import re
    return re.escape(s)


def encode_non_finite(value: Column, labels: Column | None = None) -> Column:
    """NaN / +-inf -> sentinel, with label nan=true; returns struct(value, labels)."""
    bad = F.isnan(value) | (value == float("inf")) | (value == float("-inf"))
    lab = labels if labels is not None else F.create_map().cast("map<string,string>")
    return F.struct(F.when(bad, F.lit(NAN_SENTINEL)).otherwise(value).alias("value"),
                    F.when(bad, F.map_concat(F.map_filter(lab, lambda k, _: k != "nan"),
                                             F.create_map(F.lit("nan"), F.lit("true"))))
                    .otherwise(lab).alias("labels"))


def short_model_name(path: Column) -> Column:
    """Last path component of a model path (trailing slashes ignored)."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def versioned_name(name: Column, ts: Column) -> Column:
    """``name-YYYYmmdd-HHMMSS`` version stamp."""
    return F.concat(name, F.lit("-"), F.date_format(ts, "yyyyMMdd-HHmmss"))


def empty_outputs(df: DataFrame, idx: str = "idx", output: str = "output",
                  instruction: str = "instruction", n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(count of empty outputs, first n offenders with a 80-character instruction)."""
    o = F.col(output)
    bad = df.where(o.isNull() | T.is_blank(o))
    count = bad.agg(F.count(F.lit(1)).alias("n_empty"))
    first = bad.select(idx, F.substring(F.coalesce(F.col(instruction), F.lit("")), 1, 80).alias("instruction80")) \
        .orderBy(idx).limit(n)
    return count, first


def render_with(df: DataFrame, fn, out: str = "text", *cols: str) -> DataFrame:
    """Formatting hook: apply any ``Column -> Column`` template (or several columns -> Column)."""
    return df.withColumn(out, fn(*[F.col(c) for c in cols]))


def join_turns(turns: DataFrame, key: str, order: str, piece: Column, sep: str = "", out: str = "text") -> DataFrame:
    """Render per turn row, then concatenate the pieces of each record in ``order``.

    The piece (a template of one message) is built row by row inside codegen;
    only the finished strings are gathered per record, so the gather carries
    no structs and no lambda runs over the list.
    """
    rows = turns.select(key, F.struct(F.col(order).alias("o"), piece.alias("p")).alias("_x"))
    return (rows.groupBy(key).agg(F.sort_array(F.collect_list("_x")).alias("_l"))
            .select(key, F.array_join(F.col("_l.p"), sep).alias(out)))


def fallback_piece(role: Column, content: Column) -> Column:
    """P3 piece of one turn (system turns render as ''); a null content is empty, its turn stays."""
    content = F.coalesce(content, F.lit(""))
    return (F.when(role == "user", F.concat(F.lit(FALLBACK_USER), content, F.lit(FALLBACK_ASSISTANT)))
            .when(role == "assistant", F.concat(content, F.lit(FALLBACK_TURN_END))).otherwise(F.lit("")))


def chatml_piece(role: Column, content: Column) -> Column:
    """P4 piece of one turn."""
    return F.concat(F.lit(IM_START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(IM_END + "\n"))
