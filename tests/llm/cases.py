"""Rows and plain readings that the tests share."""

import re
from collections import Counter

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def documents(spark, rows, extra=False):
    """A documents table from (doc_id, text); with ``extra``, columns whose names the operators use inside."""
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([(i, t, None if t is None else "en", "s", len(t or "")) for i, t in rows], kinds)
    if extra:
        for c in ("node", "row", "d", "kept", "weight", "probability", "toxic_score", "words", "held_id", "score", "kinds"):
            df = df.withColumn(c, F.lit("theirs"))
    return df


EDGES = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four five six"), (4, "one two three four five six"),
         (5, "ONE two, three four five six!"), (None, "no id here at all my friend"), (6, "é漢字 " * 3), (7, "lorem ipsum dolor " * 20_000)]
