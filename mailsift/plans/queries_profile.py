"""Profiling queries: AGG-1 ... AGG-8."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators import profile as prof
from mailsift.plans.registry import register, sql_list
from mailsift.sources import tables as tb

# The WS / W classes are written so RE2 (DuckDB) reads them like Java does.
WS = P.WS
STOP_SQL = sql_list(P.english_stopwords())

# Lower-cased whitespace words made only of letters, stop words removed.
_WORDS = ("words", "SELECT y, w AS word FROM (SELECT y, unnest(regexp_split_to_array(lower(body), "
          f"'{WS}+')) AS w FROM mail) WHERE regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN {STOP_SQL}")


@register("agg1_rows_per_label", tb.with_views("SELECT y, count(*) AS n FROM mail GROUP BY y", "mail"))
def agg1_rows_per_label(spark, d):
    return prof.rows_per_label(tb.mail(spark, d), "y")


_SPECIAL_SQL = f"length(regexp_replace(lower(body), '[\\p{{L}}\\p{{N}}{P.WS_CLASS}]', '', 'g'))"


@register("agg2_special_chars", tb.with_views(
    f"SELECT row_id, y, CAST({_SPECIAL_SQL} AS BIGINT) AS special_characters FROM mail", "mail"))
def agg2_special_chars(spark, d):
    return prof.with_special_chars(tb.mail(spark, d)).select("row_id", "y", "special_characters")


@register("agg3_special_char_boxplot", tb.with_views(
    """SELECT s.y, q1, median, q3, count(*) AS n,
              CAST(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS BIGINT) AS whisker_lo,
              CAST(max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS BIGINT) AS whisker_hi,
              count(CASE WHEN NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) THEN 1 END) AS n_outliers
       FROM s JOIN (SELECT y, CAST(quantile_cont(v, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(v, 0.5) AS DOUBLE) AS median,
                           CAST(quantile_cont(v, 0.75) AS DOUBLE) AS q3 FROM s GROUP BY y) q ON s.y = q.y
       GROUP BY s.y, q1, median, q3""",
    "mail", extra=[("s", f"SELECT y, {_SPECIAL_SQL} AS v FROM mail")]))
def agg3_special_char_boxplot(spark, d):
    return prof.box_stats(prof.with_special_chars(tb.mail(spark, d)), "special_characters", "y")


_PRICE_BOX_SQL = """
WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
     s AS (SELECT q.*, o_totalprice AS v, o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1) AS inside
           FROM orders JOIN q ON o_orderpriority = g)
SELECT g AS o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
       min(CASE WHEN inside THEN v END) AS whisker_lo, max(CASE WHEN inside THEN v END) AS whisker_hi,
       count(CASE WHEN NOT inside THEN 1 END) AS n_outliers
FROM s GROUP BY g, q1, median, q3"""


@register("agg3_price_boxplot", _PRICE_BOX_SQL)
def agg3_price_boxplot(spark, d):
    """AGG-3 on real-valued input: nearly every value is distinct."""
    box = prof.box_stats(tb.load(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return box.select("o_orderpriority", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "n", "whisker_lo", "whisker_hi", "n_outliers")


@register("agg4_top_words_phishing", tb.with_views(
    "SELECT word, count(*) AS n FROM words WHERE y = 1 GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "mail", extra=[_WORDS]))
def agg4_top_words_phishing(spark, d):
    return prof.top_words(tb.mail(spark, d).filter(F.col("y") == 1), "body", 20)


@register("agg5_top_words_legitimate", tb.with_views(
    "SELECT word, count(*) AS n FROM words WHERE y = 0 GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "mail", extra=[_WORDS]))
def agg5_top_words_legitimate(spark, d):
    return prof.top_words(tb.mail(spark, d).filter(F.col("y") == 0), "body", 20)


AGG6_SQL = tb.with_views(
    """SELECT word, n_pos AS n FROM (
         SELECT word, count(CASE WHEN y = 1 THEN 1 END) AS n_pos, count(CASE WHEN y <> 1 THEN 1 END) AS n_other
         FROM words GROUP BY word) c
       WHERE n_pos > 0 AND n_other = 0 ORDER BY n DESC, word LIMIT 20""",
    "mail", extra=[_WORDS])


@register("agg6_class_unique_words", AGG6_SQL)
def agg6_class_unique_words(spark, d):
    return prof.class_unique_words(tb.mail(spark, d), "y", 1, "body", 20)


@register("agg7_token_frequency", tb.with_views(
    """SELECT token, count(*) AS freq FROM (
         SELECT unnest(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}_]+')) AS token FROM mail)
       WHERE token <> '' GROUP BY token""", "mail"))
def agg7_token_frequency(spark, d):
    m = tb.mail(spark, d)
    return prof.token_frequency(m, X.simple_tokens("body"))


@register("agg8_null_shape", tb.with_views(
    """SELECT count(*) AS n_rows,
              count(CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL AND subject IS NOT NULL
                          AND body IS NOT NULL AND label IS NOT NULL THEN 1 END) AS n_rows_complete,
              CAST(5 AS BIGINT) AS n_cols
       FROM mail_subject""", "mail_subject"))
def agg8_null_shape(spark, d):
    return prof.null_shape(tb.mail_subject(spark, d))
