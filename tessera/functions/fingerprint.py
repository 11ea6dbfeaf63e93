"""Content fingerprint of a message list.

The fingerprint is ``"sha256:" + first 16 hex digits of sha256(canonical)``,
where *canonical* is the message list printed as JSON with sorted keys,
``", "`` / ``": "`` separators and non-ASCII characters kept, i.e. what
``json.dumps(messages, ensure_ascii=False, sort_keys=True)`` prints.  It is
built by string functions so it runs in whole-stage codegen.  Only records
whose messages hold nested or float values, or are no list of objects, go
through Python's own ``json`` in Arrow batches (``python_canonical``): how
Python prints those cannot be told from a parsed value (1.0 and 1 are one).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: prefix and digest length of the fingerprint
HASH_PREFIX = "sha256:"
HASH_HEX_DIGITS = 16


def json_string(c: Column) -> Column:
    """JSON text of a string value as Python prints it (``null`` for null).

    Spark escapes control characters as ``\\u001F``; Python prints lower-case
    hex digits, so the six letters are lowered (only in real escapes, i.e.
    after an even run of backslashes).
    """
    j = F.to_json(F.array(c))
    out = j.substr(F.lit(2), F.length(j) - 2)
    low = out
    for up in "ABCDEF":
        low = F.regexp_replace(low, r"(?<!\\)((?:\\\\)*)\\u00([01])" + up, "$1\\\\u00$2" + up.lower())
    # the six passes only matter when a \u00XX escape is present (control characters are rare)
    out = F.when(out.contains("\\u00"), low).otherwise(out)
    return F.when(c.isNull(), F.lit("null")).otherwise(out)


def variant_json(v: Column) -> Column:
    """Python-style JSON of a scalar VARIANT value (strings re-escaped)."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", json_string(F.try_variant_get(v, "$", "string"))) \
        .otherwise(F.coalesce(F.to_json(v), F.lit("null")))


def canonical_messages(msgs: Column) -> Column:
    """Canonical JSON of ``array<struct<role, content>>``."""
    item = F.transform(msgs, lambda m: F.concat(
        F.lit('{"content": '), json_string(m["content"]),
        F.lit(', "role": '), json_string(m["role"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(item, ", "), F.lit("]"))


def canonical_variant_messages(msgs: Column) -> Column:
    """Canonical JSON of ``array<variant>``: every key of every message, sorted."""
    def one(m: Column) -> Column:
        obj = F.try_variant_get(m, "$", "map<string,variant>")
        body = F.array_join(F.transform(F.array_sort(F.map_keys(obj)), lambda k: F.concat(
            json_string(k), F.lit(": "), variant_json(F.element_at(obj, k)))), ", ")
        return F.when(obj.isNull(), variant_json(m)).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    return F.concat(F.lit("["), F.array_join(F.transform(msgs, one), ", "), F.lit("]"))


def _python_messages(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        text = json.dumps(json.loads(raw)["messages"], ensure_ascii=False, sort_keys=True)
        text.encode()  # a lone surrogate has no UTF-8 form
        return text
    except (ValueError, KeyError, TypeError, RecursionError):
        return None


def _python_batch(raw: pd.Series) -> pd.Series:
    return raw.map(_python_messages, na_action="ignore").astype(object).where(raw.notna(), None)


def plain_messages(msgs: Column) -> Column:
    """Is the list made of objects whose values are texts, nulls, booleans or whole numbers?"""
    def one(m: Column) -> Column:
        obj = F.try_variant_get(m, "$", "map<string,variant>")
        return F.coalesce(F.forall(F.map_values(obj), lambda x: F.schema_of_variant(x).isin("STRING", "VOID", "BOOLEAN", "BIGINT")), F.lit(False))
    return F.coalesce(F.forall(msgs, one), F.lit(False))


def python_canonical(raw: Column) -> Column:
    """Canonical JSON of the ``messages`` value of a record text, whatever it is; null texts stay null and cost nothing."""
    return F.pandas_udf(_python_batch, T.StringType())(raw)


def digest(canonical: Column) -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.substring(F.sha2(canonical, 256), 1, HASH_HEX_DIGITS))


def content_hash_of_messages(msgs: Column) -> Column:
    return digest(canonical_messages(msgs))


def content_hash_of_variant_messages(msgs: Column) -> Column:
    return digest(canonical_variant_messages(msgs))
