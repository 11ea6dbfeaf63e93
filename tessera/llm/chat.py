"""Operator 8: chat formatting with typed content parts, in DataFrame functions only.

A turn is (conv_id, turn, role, parts); ``parts`` is an array of typed parts
(``PART_TYPE``).  A visitor walks the parts of a turn in order: a text part
becomes its escaped text, an image, audio or document part becomes a
placeholder such as ``<|image:1|>`` (numbered within the turn) and leaves an
attachment entry with its reference and the number of tokens it expands to.

Template of a turn: ``<|im_start|>`` role newline content ``<|im_end|>`` newline.
Escaping is reversible: a backslash is doubled and ``<|`` becomes ``<\\|``, so no
text can hold a control string; in a role a newline gets a backslash too.
``unescape`` drops each backslash and keeps the character after it.

A conversation's text is one value, so its turns are gathered in one row; that
is the result asked for, not an intermediate step.  Turns carry everything
else (escaping, visiting) before the gather, and the loss mask addresses
(turn, start, length) so that reading it back is linear.

Edge cases: null texts, roles and parts are empty; a part of unknown type is
kept as a ``<|unknown:k|>`` placeholder; null conv_ids form one conversation;
rows that repeat a turn number follow each other by role, then content;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\\n"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def text_part(c: Column) -> Column:
    """The parts of a turn that is one text."""
    none = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"),
                            none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def expanded_tokens(p: Column, patch: int, audio_per_second: float, per_page: int) -> Column:
    """Tokens a non-text part stands for: image patches, audio frames or pages, one at least."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(patch))
    n = (F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
         .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * F.lit(audio_per_second)))
         .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * F.lit(per_page)))
    return F.greatest(F.coalesce(n, F.lit(1)).cast("long"), F.lit(1).cast("long"))


def visit(parts: Column, patch: int = 14, audio_per_second: float = 25.0, per_page: int = 512) -> tuple[Column, Column]:
    """(content, attachments) of a turn's parts, in order."""
    parts = F.filter(F.coalesce(parts, F.array().cast(PART_TYPE)), lambda p: p.isNotNull())
    kind = lambda p: F.when(p["type"].isin("text", "image", "audio", "document"), p["type"]).otherwise("unknown")
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"), kind(p).alias("kind")))
    content = F.array_join(F.transform(numbered, lambda x: F.when(x["kind"] == "text", escape(F.coalesce(x["p"]["text"], F.lit(""))))
                                       .otherwise(F.concat(F.lit("<|"), x["kind"], F.lit(":"), x["i"].cast("string"), F.lit("|>")))), "")
    attachments = F.transform(F.filter(numbered, lambda x: x["kind"] != "text"),
                              lambda x: F.struct(x["kind"].alias("kind"), x["i"].alias("part"), x["p"]["ref"].alias("ref"),
                                                 expanded_tokens(x["p"], patch, audio_per_second, per_page).alias("tokens")))
    return content, attachments


def format_chats(turns: DataFrame, **visitor) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments) of (conv_id, turn, role, parts).

    ``loss_spans``: array of (turn, start, length): code points ``start`` .. of
    the formatted turn with that number (from 0) are trained on, namely the
    contents of assistant turns.  ``attachments`` adds the turn number to each
    entry of the visitor.
    """
    content, attachments = visit(F.col("parts"), **visitor)
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), content.alias("content"), attachments.alias("att"), head.alias("head"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "head", "att"))).alias("t"))
    t = F.col("t")
    formatted = F.array_join(F.transform(t, lambda x: F.concat(x["head"], x["content"], F.lit(END))), "")
    marked = F.transform(t, lambda x, i: F.struct((x["role"] == "assistant").alias("on"), i.alias("turn"), F.length(x["head"]).alias("start"),
                                                  F.length(x["content"]).alias("length")))
    spans = F.transform(F.filter(marked, lambda m: m["on"]), lambda m: F.struct(m["turn"], m["start"], m["length"]))
    att = F.flatten(F.transform(t, lambda x, i: F.transform(x["att"], lambda a: F.struct(i.alias("turn"), a["kind"].alias("kind"), a["part"].alias("part"),
                                                                                        a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return gathered.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), att.alias("attachments"))


def turns_of(formatted: Column) -> Column:
    """The formatted turns, without their end marks."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """array of (role, text): what ``format_chats`` wrote, unescaped."""
    def one(x: Column) -> Column:
        head = F.regexp_extract(x, r"(?s)^<\|im_start\|>([^\\\n]*(?:\\.[^\\\n]*)*)\n", 1)
        return F.struct(unescape(head).alias("role"), unescape(F.substr(x, F.length(head) + F.lit(len(START) + 2))).alias("text"))
    return F.transform(turns_of(formatted), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    turns = turns_of(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.get(turns, s["turn"]), s["start"] + F.lit(1), s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """Digest columns read back from formatted chats."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("_t"),
                        read_loss(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    return read.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(F.array_join("_t", ""), 256).alias("turns_sha256"),
                       F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
