"""User-code hook queries: UDF-1 ... UDF-4.

Each hook runs user Python on Arrow batches; the oracle is the same
computation written in SQL.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions import hooks as H
from mailsift.operators import evaluate as E
from mailsift.operators import models as M
from mailsift.operators import scorers as SC
from mailsift.operators import shape as S
from mailsift.plans.queries_profile import _SPECIAL_SQL
from mailsift.plans.queries_shape import SEED, split_ctes
from mailsift.plans.registry import register
from mailsift.session import shared_scratch
from mailsift.sources import tables as tb


def special_characters(text: str) -> int:
    """The notebook's per-value function: characters neither alphanumeric
    nor whitespace."""
    return sum(1 for c in text if not c.isalnum() and not c.isspace())


@register("udf1_series_apply", tb.with_views(
    f"SELECT row_id, y, CAST({_SPECIAL_SQL} AS BIGINT) AS special_characters FROM mail", "mail"))
def udf1_series_apply(spark, d):
    """UDF-1: a user's Python per-value function applied to a column
    (Arrow-batched); equals the built-in AGG-2 column function."""
    count = H.series_apply(special_characters, T.LongType())
    return tb.mail(spark, d).select("row_id", "y", count(F.lower("body")).alias("special_characters"))


_NON_WORD = re.compile(r"\W+")


def tokenize_batch(batch: pd.DataFrame) -> pd.DataFrame:
    """A batched tokenize function: the text column is replaced by its token
    count and its number of distinct tokens. The tokens of one text are held at
    a time."""
    def counts(text: str | None) -> tuple[int, int]:
        toks = [w for w in _NON_WORD.split((text or "").lower()) if w]
        return len(toks), len(set(toks))

    found = [counts(t) for t in batch["text"].astype(object).where(batch["text"].notna(), None)]
    return pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": pd.Series([n for n, _ in found], batch.index, "int64"),
                         "n_distinct": pd.Series([n for _, n in found], batch.index, "int64")})


@register("udf2_batched_map",
    "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct "
    "FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), "
    "lambda x: x <> '') AS t FROM documents)")
def udf2_batched_map(spark, d):
    """UDF-2: a batched map over all documents that drops ``text`` and adds
    ``n_tokens`` / ``n_distinct``."""
    return H.batch_map(tb.load(spark, d, "documents").select("doc_id", "text"), tokenize_batch,
                       "doc_id long, n_tokens long, n_distinct long")


_EMB_CTES = [("mail", "SELECT vec_id AS row_id, label AS y FROM embeddings")] + split_ctes(0.2, "0.5") + [
    ("cent", """SELECT y, list(v ORDER BY i) AS c FROM (
  SELECT y, i, avg(v) AS v FROM (
    SELECT s.y, unnest(e.embedding) AS v, generate_subscripts(e.embedding, 1) AS i
    FROM splits s JOIN embeddings e ON e.vec_id = s.row_id WHERE s.split = 'train')
  GROUP BY y, i) GROUP BY y"""),
    ("dist", """SELECT s.row_id, s.y AS y_true, c.y AS cls, list_distance(CAST(e.embedding AS DOUBLE[]), c.c) AS d
FROM splits s JOIN embeddings e ON e.vec_id = s.row_id JOIN cent c ON true WHERE s.split = 'test'"""),
    ("p", "SELECT row_id, y_true, CAST(arg_min(cls, d) AS INTEGER) AS y_pred, min(d) AS dist FROM dist "
          "GROUP BY row_id, y_true"),
]


def centroid_scores(spark, d):
    """Nearest-centroid model: centroids fitted by Spark on the train split
    of ``embeddings``, test rows scored through the external-scorer hook."""
    emb = tb.load(spark, d, "embeddings").withColumnRenamed("vec_id", "row_id")
    sp = S.stored_split(emb, "label", "row_id", 0.2, 0.5, SEED)
    labels, cents = M.fit_centroids(sp.filter(F.col("split") == "train"), "label", "embedding")
    scorer = M.external_scorer(M.centroid_predict_fn(cents), T.ArrayType(T.DoubleType()), batch_size=64,
                               input_tensor_shapes=[[len(cents[0])]])
    test = sp.filter(F.col("split") == "test").withColumn("_d", scorer(F.col("embedding")))
    near = F.array_position(F.col("_d"), F.array_min("_d")).cast("int")
    return labels, test.select("row_id", F.col("label").alias("y_true"),
                               F.element_at(F.array(*[F.lit(v) for v in labels]), near).alias("y_pred"),
                               F.array_min("_d").alias("dist"))


@register("udf4_external_scorer", tb.with_views(
    "SELECT row_id, y_true, y_pred, round(dist, 6) AS dist FROM p", extra=_EMB_CTES))
def udf4_external_scorer(spark, d):
    """UDF-4: a pluggable model (here nearest centroid) scoring through
    ``predict_batch_udf`` in batches of 64 rows."""
    return centroid_scores(spark, d)[1].withColumn("dist", F.round("dist", 6))


@register("udf4_scorer_by_path", tb.with_views(
    "SELECT row_id, y_true, y_pred, round(dist, 6) AS dist FROM p", extra=_EMB_CTES))
def udf4_scorer_by_path(spark, d):
    """UDF-4 with the model chosen by its folder: the centroids of the train split are
    saved with their manifest and loaded by the workers from there."""
    emb = tb.load(spark, d, "embeddings").withColumnRenamed("vec_id", "row_id")
    sp = S.stored_split(emb, "label", "row_id", 0.2, 0.5, SEED)
    labels, cents = M.fit_centroids(sp.filter(F.col("split") == "train"), "label", "embedding")
    folder = f"{shared_scratch(spark, 'scorers')}/{uuid.uuid4().hex}"
    SC.save_scorer(spark, folder, SC.CENTROIDS, SC.centroid_payload(cents), ["embedding"], [[len(cents[0])]])
    test = sp.filter(F.col("split") == "test").withColumn("_d", SC.scorer_at(spark, folder))
    near = F.array_position(F.col("_d"), F.array_min("_d")).cast("int")
    return test.select("row_id", F.col("label").alias("y_true"), F.element_at(F.array(*[F.lit(v) for v in labels]), near).alias("y_pred"),
                       F.round(F.array_min("_d"), 6).alias("dist"))


@register("udf3_metric_callback", tb.with_views("""
SELECT 'accuracy' AS metric, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) AS value FROM p
UNION ALL SELECT 'precision', round(avg(precision), 9) FROM pc
UNION ALL SELECT 'recall', round(avg(recall), 9) FROM pc
UNION ALL SELECT 'f1', round(avg(f1), 9) FROM pc""", extra=_EMB_CTES + [("pc", """
SELECT c.y AS class_id,
       CASE WHEN count(CASE WHEN p.y_pred = c.y THEN 1 END) > 0 THEN
         count(CASE WHEN p.y_pred = c.y AND p.y_true = c.y THEN 1 END) * 1.0
         / count(CASE WHEN p.y_pred = c.y THEN 1 END) ELSE 0.0 END AS precision,
       CASE WHEN count(CASE WHEN p.y_true = c.y THEN 1 END) > 0 THEN
         count(CASE WHEN p.y_pred = c.y AND p.y_true = c.y THEN 1 END) * 1.0
         / count(CASE WHEN p.y_true = c.y THEN 1 END) ELSE 0.0 END AS recall,
       CASE WHEN count(CASE WHEN p.y_true = c.y THEN 1 END) + count(CASE WHEN p.y_pred = c.y THEN 1 END) > 0 THEN
         2.0 * count(CASE WHEN p.y_pred = c.y AND p.y_true = c.y THEN 1 END)
         / (count(CASE WHEN p.y_true = c.y THEN 1 END) + count(CASE WHEN p.y_pred = c.y THEN 1 END))
       ELSE 0.0 END AS f1
FROM cent c JOIN p ON true GROUP BY c.y""")]))
def udf3_metric_callback(spark, d):
    """UDF-3: the training loop's metric callback (accuracy, macro P/R/F1 as
    (metric, value) rows) on the external scorer's predictions."""
    labels, pred = centroid_scores(spark, d)
    m = E.metric_rows(pred, labels, "y_true", "y_pred", "macro")
    return m.select("metric", F.round("value", 9).alias("value"))
