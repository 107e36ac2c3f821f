"""Text matches: leading word boundary, title wildcard, and fuzzy by Jaro-Winkler on UTF-8 bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An ASCII word boundary with Unicode case folding, in Java's syntax.
BOUNDARY = r"(?iu)(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
UNICODE_BOUNDARY = r"(?iuU)\b"
FUZZY = 0.9


def word_match(column: Column, mention: str, unicode: bool = False) -> Column:
    """The mention begins at a word boundary ("Russia" finds "Russian Empire", not "Prussia")."""
    return column.rlike((UNICODE_BOUNDARY if unicode else BOUNDARY) + re.sub(r"([^\w\s])", r"\\\1", mention, flags=re.ASCII))


def title_match(column: Column, mention: str) -> Column:
    """Spaces stand for anything; % and _ of the mention are wildcards, a backslash is itself."""
    return column.ilike("%" + "%".join(mention.replace("\\", "\\\\").split(" ")) + "%")


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """Similarity of the UTF-8 bytes; the common start (4 at most) counts only above a Jaro value of 0.7."""
    if a is None or b is None:
        return None
    x, y = a.encode(), b.encode()
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    taken = bytearray(len(y))
    common = []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not taken[j] and y[j] == c:
                taken[j] = 1
                common.append(c)
                break
    if not common:
        return 0.0
    other = [c for c, t in zip(y, taken, strict=True) if t]
    swaps = sum(p != q for p, q in zip(common, other, strict=True)) // 2
    m = len(common)
    jaro = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    start = next((k for k in range(min(4, len(x), len(y))) if x[k] != y[k]), min(4, len(x), len(y)))
    return jaro + 0.1 * start * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_labels(labels: DataFrame, mention: str, column: str = "label", threshold: float = FUZZY) -> DataFrame:
    """The distinct labels in which every word of the mention has a word of similarity `threshold` or more.

    Each distinct word is scored once. A similarity of t needs a Jaro value of (t - 0.4) / 0.6, which is (2 + r) / 3 at most
    where r is the ratio of the lengths; so words of a ratio under 5 t - 4 are left out before Python sees them.
    """
    wanted = mention.split(" ")
    split = labels.select(column).distinct().where(F.col(column).isNotNull())
    pairs = split.select(column, F.explode(F.array_distinct(F.split(column, " "))).alias("word"))
    scored = pairs.select("word").distinct().select("word", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(wanted)))).alias("q")).select("word", "q.*")
    n, m = F.octet_length("word"), F.octet_length("w")
    ratio = max(5 * threshold - 4, 0.0) - 1e-9
    hits = scored.where((F.least(n, m) >= F.greatest(n, m) * ratio) & (jaro_winkler_udf("w", "word") >= threshold)).select("word", "i")
    return pairs.join(hits, "word").groupBy(column).agg(F.countDistinct("i").alias("k")).where(F.col("k") == len(wanted)).select(column)
