"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space squeezed, ends trimmed) and
hashed; per host the documents that hold a line are counted. Lines above the
limit (more than ``min_docs`` documents and more than ``share`` of the host's)
are boilerplate and removed; documents that lose more than ``depleted`` of their
words are rejected, as are documents that fail the base rules (too few words, or
too many words in repeated 8-word windows).

A host can have at most (its lines / its documents) / share lines above the
limit, so what is kept per host does not grow with the corpus. The counts are
pre-aggregated; the lists are joined to the documents by host, broadcast only
if the written table is small enough for Spark's own threshold.

Only DataFrame functions are used. Defined results: null text has no word and
fails the base rules; a null host is a host; every row is a document of its
own, whatever its id; lines without a word are kept and not counted. Windows
and lines compare by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.tables import handoff

MIN_DOCS = 20
SHARE = 0.1
DEPLETED = 0.7
_SPACE = r"[\\x20\\x09-\\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HASHES = f"transform(split(text, '\\n', -1), l -> xxhash64(trim(regexp_replace({_LOWER.format('l')}, '{_SPACE}', ' '))))"
_HAS_WORD = r"l RLIKE '[^\\x20\\x09-\\x0D]'"
_WORDS = f"array_remove(split({{}}, '{_SPACE}', -1), '')"
# Words covered by windows found twice or more: window starts sorted, each adds what the next does not cover.
_COVERED = """
aggregate(
  zip_with(_starts, slice(_starts, 2, size(_starts)), (a, b) -> least(8, coalesce(b - a, 8))),
  0L, (sum, x) -> sum + x)
"""
_STARTS = """
array_sort(array_distinct(flatten(transform(
  filter(
    zip_with(slice(_sorted, 1, size(_sorted) - 1), slice(_sorted, 2, size(_sorted) - 1), (a, b) -> IF(a.h = b.h, array(a.i, b.i), null)),
    p -> p IS NOT NULL), p -> p))))
"""


def _key(host: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("null"))


def boilerplate(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host_key, boiler): the hashes of each host's lines above the limit."""
    held = docs.select(_key(host).alias("host_key"), "text")
    sizes = held.groupBy("host_key").agg(F.count("*").alias("docs"))
    lines = held.where("text IS NOT NULL").select("host_key", F.explode(F.expr(f"array_distinct({_HASHES})")).alias("line"))
    counts = lines.groupBy("host_key", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).where(F.col("line") != F.xxhash64(F.lit("")))
    return counts.join(sizes, "host_key").where(F.col("n") > F.col("docs") * share).groupBy("host_key").agg(F.collect_list("line").alias("boiler"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of the base rules and base_failed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_w", F.expr(_WORDS.format("_t"))).withColumn("_l", F.expr(f"filter(split(_t, '\\n', -1), l -> {_HAS_WORD})"))
    out = (out.withColumn("n_words", F.size("_w").cast("long"))
           .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
           .withColumn("n_symbols", (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long"))
           .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
           .withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))")))
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words from those of half as many
        left, right = (f"slice(_h, {at}, greatest(size(_h) - {step}, 0))" for at in (1, 1 + step))
        out = out.withColumn("_h", F.expr(f"zip_with({left}, {right}, (a, b) -> xxhash64(a, b))"))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_sorted", F.when(again, F.expr("sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i)))")))
    out = out.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.expr(_STARTS)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.expr(_COVERED), F.lit(0).cast("long")))
    return out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")).drop("_l", "_h", "_sorted", "_starts", "_w")



def rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept_text (without boilerplate lines),
    n_kept_words and kept. Columns of these names in ``docs`` are replaced."""
    lists = handoff(boilerplate(docs, host, min_docs, share), "boiler")
    out = measured(docs).withColumn("_key", _key(host)).join(lists.withColumnRenamed("host_key", "_key").withColumnRenamed("boiler", "_boiler"), "_key", "left")
    lines = f"zip_with(split(_t, '\\n', -1), {_HASHES.replace('text', '_t')}, (l, h) -> IF(array_contains(_boiler, h), null, l))"
    out = out.withColumn("kept_text", F.expr(f"IF(_boiler IS NULL, _t, array_join(filter({lines}, l -> l IS NOT NULL), '\\n'))"))
    out = out.withColumn("n_kept_words", F.expr(f"IF(_boiler IS NULL, n_words, CAST(size({_WORDS.format('kept_text')}) AS BIGINT))"))
    # The row number keeps a filter on the verdict above these steps; pushed below, it would repeat them for every use.
    out = out.withColumn("_row", F.monotonically_increasing_id())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_kept_words") >= F.col("n_words") * (1 - depleted)) & (F.col("_row") >= 0))
    return out.drop("_key", "_boiler", "_t", "_row")
