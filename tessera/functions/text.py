"""Column -> Column text helpers with Python string semantics.

Python's ``str.strip()``, ``\\s``, ``\\d`` and ``\\b`` are Unicode aware while
Java regex (Spark) and RE2 (DuckDB) are ASCII by default.  The classes below
spell the Unicode sets out so the same pattern text means the same thing in
Spark, in DuckDB oracles and in the Python code the jobs replace.
All patterns here are legal in both Java regex and RE2 (no look-around).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as Python's str.isspace() sees it.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# The same set as characters (rule: every code point whose str.isspace() is true), for btrim.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Leading or trailing whitespace run (replace with '' to strip).
STRIP = rf"^{WS}+|{WS}+\z"
# Unicode decimal digit (Python \d on str).
DIGIT = r"\p{Nd}"
# A character Python's \w would NOT match (used instead of \b).
NONWORD = r"[^\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: trims exactly the characters of WS_CHARS from both ends.

    ``btrim`` looks only at the two ends; the regex STRIP (used by the SQL
    oracles) has to scan every whitespace run of the text.
    """
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """``not str(c).strip()`` for a non-null string."""
    return strip(c) == F.lit("")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def after_first_line(c: Column) -> Column:
    """Everything after the first newline ('' when there is none)."""
    pos = F.instr(c, "\n")
    return F.when(pos > 0, c.substr(pos + 1, F.lit(1 << 30))).otherwise(F.lit(""))


def whitespace_tokens(c: Column) -> Column:
    """``str.split()``: runs of Unicode whitespace separate tokens.

    The split leaves an empty string only before a leading or after a trailing
    run; ``array_remove`` drops them without a per-element lambda.
    """
    return F.array_remove(F.split(c, f"{WS}+"), "")


def truthy_string(c: Column) -> Column:
    """Python truthiness of an optional string value: not null and not ''."""
    return c.isNotNull() & (c != F.lit(""))


def re_fullmatch_unicode(c: Column, body: str, ignore_case: bool = False) -> Column:
    """``re.match(r'^body$')`` where ``$`` also accepts one trailing newline."""
    flags = "(?i)" if ignore_case else ""
    return c.rlike(f"{flags}^{body}\\n?\\z")
