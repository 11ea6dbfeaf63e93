"""Small tables with the awkward rows every operator must take."""

import hashlib
import re
import zlib

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, lang, source) rows as a documents table with columns of clashing names."""
    full = [(r + (None, None))[:4] + (len(r[1]) if r[1] is not None else None,) for r in map(tuple, rows)]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", "1 as row", "'x' as spans", "2 as fp", "3 as kept_id", "'y' as redact_cut", "'z' as langid_text", "0.5 as score",
                         "'w' as scanned_text", "'en' as lang_pred")


LONG = " ".join(f"word{k % 977}" for k in range(30_000))
AWKWARD = [(0, None), (1, ""), (2, "  \n\t "), (3, "..."), (4, "one"), (5, "one"), (5, "one"), (6, "A\x00b É ﬁ 日本語   x"), (7, LONG), (8, LONG), (9, "x" * 70_000),
           (None, "no id at all here"), (None, None)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
