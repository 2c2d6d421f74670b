"""Text helpers. All stay in built-in expressions."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F


def concat_strict(*cols):
    """Concatenate; one null makes the result null."""
    return F.concat(*cols)


def concat_blank(*cols):
    """Concatenate; null counts as the empty string."""
    return F.concat_ws("", *cols)


def join_parts(*cols, sep=" "):
    """Join only the parts that are neither null nor empty."""
    return F.concat_ws(sep, *[F.when(c != "", c) for c in cols])


def blank_if(col, word):
    """Empty string where the column holds a filler word, else the column."""
    return F.when(col == word, F.lit("")).otherwise(col)


def trimmed_or_null(col):
    return F.nullif(F.trim(col), F.lit(""))


def varchar(col, width):
    """Text cast that cuts at ``width`` characters."""
    return F.substring(col.cast("string"), 1, width)


def initial_in(col, low, high):
    """First letter inside a closed, upper-case letter range."""
    return F.substring(col, 1, 1).between(low, high)


def like_any(col, patterns):
    """Any of several LIKE patterns."""
    return reduce(or_, [col.like(p) for p in patterns])
