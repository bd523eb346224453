"""Vocabulary, encoding and vector features (FEA-1 ... FEA-7).

The vocabulary is a top-k of ``max_size`` rows. It is joined without a hint:
handed off first, its size is known, and Spark broadcasts it where that is
small enough; never a per-row map literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators.profile import token_frequency
from mailsift.session import handoff

PAD, UNK = "<pad>", "<unk>"
PAD_ID, UNK_ID = 0, 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_vocab(df: DataFrame, tokens: Column | str, min_freq: int = 2, max_size: int = 50000) -> DataFrame:
    """FEA-1: tokens with ``freq >= min_freq``, ordered (freq desc, token asc),
    the first ``max_size - 2`` get ids from 2; ``<pad>``=0, ``<unk>``=1.

    Counting is a partial + final hash aggregate; the ordering is a top-k
    (per-partition heaps then a merge), so only ``max_size`` rows ever meet
    in one task for the id numbering."""
    spark = df.sparkSession
    freq = token_frequency(df, _col(tokens)).filter(F.col("freq") >= min_freq)
    top = freq.orderBy(F.col("freq").desc(), F.col("token")).limit(max(0, max_size - 2))
    w = Window.orderBy(F.col("freq").desc(), F.col("token"))
    ids = top.select("token", "freq", (F.row_number().over(w) + 1).cast("long").alias("id"))
    specials = spark.createDataFrame([(PAD, 0, PAD_ID), (UNK, 0, UNK_ID)], "token string, freq long, id long")
    return specials.unionByName(ids)


def encode_ids(df: DataFrame, key: str, tokens: Column | str, vocab: DataFrame, max_len: int = 256,
               out: str = "ids") -> DataFrame:
    """FEA-2 (+SHP-8): first ``max_len`` tokens -> ids (``<unk>`` if absent),
    right-padded with 0 to ``max_len``. Empty texts become all-pad rows.

    ``slice`` -> ``posexplode_outer`` -> left join with the vocabulary -> regroup
    per ``key`` (one shuffle of at most ``max_len`` rows per key). The join has
    no hint: a vocabulary below Spark's broadcast threshold (hand it off first,
    so that its size is known) is broadcast, a larger one is joined by token
    with skewed tokens split. ``key`` must be unique: a repeated key raises."""
    ex = df.select(key, F.posexplode_outer(F.slice(_col(tokens), 1, max_len)).alias("_pos", "_tok"))
    v = vocab.select(F.col("token").alias("_tok"), F.col("id").cast("int").alias("_id"))
    item = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_id", F.lit(UNK_ID)).alias("id")))
    g = ex.join(v, "_tok", "left").groupBy(key).agg(
        F.sort_array(F.collect_list(item)).alias("_s"), F.max("_pos").alias("_last"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    ids = F.when(F.col("_n") == F.coalesce(F.col("_last") + 1, F.lit(1)), F.transform("_s", lambda s: s["id"])).otherwise(twice.cast("array<int>"))
    ids = F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size("_s")))
    return g.select(key, ids.alias(out))


def attention_mask(ids: Column | str) -> Column:
    """FEA-3: 1 where the id is not padding."""
    return F.transform(_col(ids), lambda x: (x != PAD_ID).cast("int"))


def real_length(ids: Column | str) -> Column:
    """FEA-3: number of non-pad ids, at least 1 (the mean-pool divisor)."""
    return F.greatest(F.lit(1), F.size(F.filter(_col(ids), lambda x: x != PAD_ID))).cast("long")


def bow_tokens(text: Column | str, stopwords: Sequence[str] | None = None) -> Column:
    """FEA-4 tokenizer: lower-case runs of 2+ word characters, stop words out."""
    toks = F.regexp_extract_all(F.lower(_col(text)), F.lit("[" + P.W_CLASS + "]{2,}"), 0)
    sw = P.english_stopwords() if stopwords is None else stopwords
    return F.filter(toks, lambda t: ~t.isin(*sw)) if sw else toks


def bag_of_words(train: DataFrame, test: DataFrame, key: str, text: str,
                 stopwords: Sequence[str] | None = None) -> DataFrame:
    """FEA-4: (row, term, count) triples of ``test`` over the vocabulary fitted
    on ``train`` only. The fitted vocabulary is as large as the corpus allows,
    so it is joined by shuffle (left semi), not broadcast."""
    vocab = (train.select(X.explode_values(bow_tokens(text, stopwords)).alias("term"))
             .filter(F.col("term").isNotNull()).distinct())
    terms = (test.select(key, X.explode_values(bow_tokens(text, stopwords)).alias("term"))
             .filter(F.col("term").isNotNull()))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(vocab, "term", "left_semi")


def truncate_pad(df: DataFrame, tokens: str, group: str, max_len: int, pad: str = PAD,
                 out: str = "padded") -> DataFrame:
    """FEA-5: truncate to ``max_len`` and pad to the longest row of the same
    ``group`` (a batch / split). The maxima, one row per group, are handed off:
    with a few groups the planner knows that they are small and no row is
    shuffled by its group."""
    sliced = df.withColumn("_t", F.slice(F.col(tokens), 1, max_len))
    longest = handoff(sliced.groupBy(group).agg(F.max(F.size("_t")).alias("_m")), "longest")
    j = sliced.join(longest, group)
    padded = F.concat("_t", F.array_repeat(F.lit(pad), F.col("_m") - F.size("_t")))
    return j.withColumn(out, padded).drop("_t", "_m")


def mean_vectors(df: DataFrame, group: Sequence[str] | str, vec: str, out: str = "mean") -> DataFrame:
    """FEA-6 (explicit form): mean of array vectors per group with the ML
    ``Summarizer`` (one pass, no explode of dimensions)."""
    groups = [group] if isinstance(group, str) else list(group)
    v = df.select(*groups, array_to_vector(F.col(vec)).alias("_v"))
    agg = v.groupBy(*groups).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return agg.select(*groups, vector_to_array("_m").alias(out))


def masked_mean_pool(df: DataFrame, key: str, ids: str, vectors: DataFrame, id_col: str = "id",
                     vec: str = "vector", out: str = "pooled") -> DataFrame:
    """FEA-6 on token ids: mean of the token vectors of the non-pad ids of
    each row. Pads carry no weight; a row without other ids, or whose ids have
    no vector, gets the zero vector."""
    ex = df.select(key, F.explode(F.filter(F.col(ids), lambda x: x != PAD_ID)).alias(id_col))
    j = ex.join(vectors.select(id_col, vec), id_col)
    width = vectors.select(F.size(vec).alias("n")).first()
    zero = F.array_repeat(F.lit(0.0), width["n"] if width else 0)
    pooled = df.select(key).distinct().join(mean_vectors(j, key, vec, out), key, "left")
    return pooled.withColumn(out, F.coalesce(out, zero))


def decode_ids(df: DataFrame, key: str, ids: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """FEA-7: ids -> tokens (pads dropped), joined by one space; an unknown id
    is left out. One shuffle, by ``key`` (unique)."""
    ex = df.select(key, F.posexplode_outer(F.filter(F.col(ids), lambda x: x != PAD_ID)).alias("_pos", "_id"))
    v = vocab.select(F.col("id").cast("int").alias("_id"), F.col("token").alias("_tok"))
    item = F.when(F.col("_tok").isNotNull(), F.struct("_pos", "_tok"))
    g = ex.join(v, "_id", "left").groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    return g.select(key, F.array_join(F.transform("_s", lambda s: s["_tok"]), " ").alias(out))
