"""Per-class profiling of mail (AGG-1 ... AGG-8).

Word statistics are one explode + one hash aggregate: Spark combines partial
counts map-side, so a word (or a class) holding a large share of all rows
never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators.quantiles import quantiles
from mailsift.session import handoff


def rows_per_label(df: DataFrame, label: str = "y") -> DataFrame:
    """AGG-1: number of rows per label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def with_special_chars(df: DataFrame, text: str = "body", out: str = "special_characters") -> DataFrame:
    """AGG-2: special characters per mail (on the lower-cased text)."""
    return df.withColumn(out, X.special_char_count(F.lower(F.col(text))).cast("long"))


def box_stats(df: DataFrame, value: str, by: str, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """AGG-3: box-plot statistics of ``value`` per ``by``.

    Quartiles are exact and linear-interpolated, found by distributed selection
    (``quantiles``), or ``percentile_approx`` when ``approx``. Whiskers are the
    most extreme values within 1.5 IQR of the box; outliers are counted. The
    quartile table has one row per group; it is handed off, so that the planner
    knows its size, and joined back for a second aggregate pass.
    """
    v = F.col(value)
    if approx:
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
        quart = df.groupBy(by).agg(q.alias("_q")).select(by, *(F.col("_q")[k].cast("double").alias(f"q{k}") for k in range(3)))
    else:
        quart = quantiles(df, value, by, (0.25, 0.5, 0.75))
    quart = quart.select(by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    joined = df.select(by, value).join(handoff(quart, "quartiles"), by)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= lo) & (v <= hi)
    return (joined.groupBy(by, "q1", "median", "q3")
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.min(F.when(inside, v)).alias("whisker_lo"),
                       F.max(F.when(inside, v)).alias("whisker_hi"),
                       F.count(F.when(~inside, F.lit(1))).alias("n_outliers")))


def _words(df: DataFrame, text: str, label: str | None, stopwords: Sequence[str]) -> DataFrame:
    cols = [X.explode_values(X.alpha_words(F.lower(F.col(text)))).alias("word")]
    if label:
        cols.insert(0, F.col(label))
    words = df.select(*cols).filter(F.col("word").isNotNull())
    return words.filter(~F.col("word").isin(*stopwords)) if stopwords else words


def top_words(df: DataFrame, text: str = "body", k: int = 20,
              stopwords: Sequence[str] | None = None) -> DataFrame:
    """AGG-4 / AGG-5: the ``k`` most common all-letter, non-stop words.

    Apply to one class by filtering first (``df.filter(y == 1)``); the filter
    reaches the scan. Ties are broken by ``word`` ascending.
    """
    sw = P.english_stopwords() if stopwords is None else stopwords
    counts = _words(df, text, None, sw).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("word")).limit(k)


def class_word_counts(df: DataFrame, label: str, positive, text: str = "body",
                      stopwords: Sequence[str] | None = None) -> DataFrame:
    """Per word: occurrences in the positive class and in all other rows.

    One shuffle for both classes (conditional counts), instead of two
    aggregations and a join.
    """
    sw = P.english_stopwords() if stopwords is None else stopwords
    is_pos = F.col(label) == F.lit(positive)
    return (_words(df, text, label, sw)
            .groupBy("word")
            .agg(F.count(F.when(is_pos, F.lit(1))).alias("n_pos"),
                 F.count(F.when(~is_pos, F.lit(1))).alias("n_other")))


def class_unique_words(df: DataFrame, label: str = "y", positive=1, text: str = "body", k: int | None = 20,
                       stopwords: Sequence[str] | None = None) -> DataFrame:
    """AGG-6 (with SHP-7): top-``k`` words of the positive class that never
    occur in the other class, by count desc then word."""
    counts = class_word_counts(df, label, positive, text, stopwords)
    uniq = counts.filter((F.col("n_pos") > 0) & (F.col("n_other") == 0)).select("word", F.col("n_pos").alias("n"))
    ordered = uniq.orderBy(F.col("n").desc(), F.col("word"))
    return ordered.limit(k) if k else ordered


def token_frequency(df: DataFrame, tokens: Column | str) -> DataFrame:
    """AGG-7: token -> frequency over a token-array column."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    toks = df.select(X.explode_values(t).alias("token")).filter(F.col("token").isNotNull())
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def null_shape(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """AGG-8 / PRJ-11: shape before and after dropping rows with nulls,
    in a single pass."""
    cols = list(subset or df.columns)
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count(F.when(complete, F.lit(1))).alias("n_rows_complete"),
                  F.lit(len(df.columns)).cast("long").alias("n_cols"))
