"""Model queries: MOD-1 ... MOD-4, MOD-6, EVL-1 (fit on train, score held-out rows).

Model outputs depend on Spark ML's optimisers, so these queries have no SQL
oracle; ``tests/test_models.py`` checks their invariants (held-out rows
only, one prediction per row, accuracy above the majority-class floor).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators import bow_models as B
from mailsift.operators import evaluate as E
from mailsift.operators import features as FE
from mailsift.operators import labels as L
from mailsift.operators import models as M
from mailsift.operators import shape as S
from mailsift.plans.queries_eval import scored_subject_mail
from mailsift.plans.queries_features import _BOW, _SPLIT
from mailsift.plans.queries_shape import SEED
from mailsift.plans.registry import register
from mailsift.session import handoff
from mailsift.sources import tables as tb


def _split(spark, d):
    sp = S.stored_split(tb.mail(spark, d), "y", "row_id", 0.2, 0.5, SEED)
    sp = sp.withColumn("label", F.col("y").cast("double"))
    return sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")


def _out(pred):
    return pred.select("row_id", "y", "y_pred", F.round("conf", 6).alias("conf"))


def fit_logreg(spark, d):
    """MOD-1 fitted on the train rows (as MOD-6 and EVL-1 need it)."""
    train, test = _split(spark, d)
    train = M.for_fit(train)
    return M.logistic_regression_bow("body", "label", n_train=train.count()).fit(train), test


@register("mod1_logreg_bow")
def mod1_logreg_bow(spark, d):
    model, test = fit_logreg(spark, d)
    return _out(M.score(model, test))


@register("mod2_decision_tree_bow")
def mod2_decision_tree_bow(spark, d):
    """Grown without a limit on depth."""
    train, test = _split(spark, d)
    model = M.decision_tree_bow("body", "label").fit(M.for_fit(train))
    return _out(M.score(model, test))


_FIRST_SPLIT = tb.with_views("""
SELECT term, threshold, round(score, 6) AS score FROM (
  SELECT term, (c + coalesce(lower, 0)) / 2.0::DOUBLE AS threshold, ((n0 - r0) ** 2 + (n1 - r1) ** 2) / (n0 + n1 - r0 - r1) + (r0 ** 2 + r1 ** 2) / (r0 + r1) AS score
  FROM s, n WHERE n0 + n1 > r0 + r1)
ORDER BY score DESC, term, threshold LIMIT 1""", "mail", extra=_SPLIT + [
    ("train_rows", "SELECT m.row_id, m.y, m.body FROM mail m JOIN splits s ON m.row_id = s.row_id WHERE s.split = 'train'"),
    ("tc", f"SELECT row_id, y, term, count(*) AS c FROM (SELECT row_id, y, unnest({_BOW}) AS term FROM train_rows m) GROUP BY row_id, y, term"),
    ("v", "SELECT term, c, CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE) AS v0, CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) AS v1 FROM tc GROUP BY term, c"),
    ("s", "SELECT term, c, lead(c) OVER w AS lower, sum(v0) OVER w AS r0, sum(v1) OVER w AS r1 FROM v WINDOW w AS (PARTITION BY term ORDER BY c DESC)"),
    ("n", "SELECT CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE) AS n0, CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) AS n1 FROM train_rows")])


@register("mod2_first_split", _FIRST_SPLIT)
def mod2_first_split(spark, d):
    """The root's split of MOD-2's tree, found on one level of growth."""
    train = _split(spark, d)[0].select("row_id", "body", "y")
    vocabulary = B.term_ids(train, "body")
    rows = B.numbered(train.withColumn("node", F.lit(0).cast("long")))
    nodes = rows.groupBy("node").agg(*(F.count_if(F.col("y") == i).alias(f"c{i}") for i in (0, 1)))
    best = B.best_splits(rows.select("_row", "node", "y"), B.term_counts(rows, "body", vocabulary), nodes, 2)
    return best.join(vocabulary, "term_id").select("term", "threshold", F.round("score", 6).alias("score"))


@register("mod3_embedding_mlp")
def mod3_embedding_mlp(spark, d):
    """Trained on the ids of FEA-2 over the vocabulary of the train rows."""
    rows = handoff(S.stored_split(tb.mail(spark, d), "y", "row_id", 0.2, 0.5, SEED)
                   .select("row_id", "y", "split", X.clean_tokens("body", passes=2).alias("tokens")), "tokens")
    vocab = handoff(FE.build_vocab(rows.filter("split = 'train'"), "tokens", 2), "vocab")
    ids = FE.encode_ids(rows, "row_id", "tokens", vocab, 256)
    rows = rows.drop("tokens").join(ids, "row_id").select("*", M.id_words("ids").alias("words"), F.col("y").cast("double").alias("label"))
    rows = handoff(rows, "ids")
    train = M.spread_for_fit(M.for_fit(rows.filter("split = 'train'")))
    model = M.embedding_mlp("words", "label", n_classes=2, seed=SEED, partitions=train.rdd.getNumPartitions()).fit(train)
    return _out(M.score(model, rows.filter("split = 'test'")))


@register("mod4_weighted_frozen_vectors")
def mod4_weighted_frozen_vectors(spark, d):
    emb = tb.load(spark, d, "embeddings")
    sp = S.stored_split(emb.withColumnRenamed("vec_id", "row_id"), "label", "row_id", 0.2, 0.5, SEED)
    sp = M.with_vector(sp, "embedding").withColumn("y", F.col("label"))
    train = sp.filter(F.col("split") == "train")
    weights = L.class_weights(train, "label").select("label", "weight")
    train = train.join(handoff(weights, "weights"), "label").withColumn("label", F.col("label").cast("double"))
    model = M.weighted_logistic_regression("features", "label", "weight").fit(M.for_fit(train))
    test = sp.filter(F.col("split") == "test")
    pred = model.transform(test).withColumn("conf", F.array_max(M.vector_to_array(F.col("probability"))))
    return _out(pred.withColumn("y_pred", F.col("prediction").cast("int")))


@register("mod6_holdout_report")
def mod6_holdout_report(spark, d):
    model, test = fit_logreg(spark, d)
    return E.classification_report(M.score(model, test), [0, 1], P.DEFAULT_ID2LABEL, "y", "y_pred")


@register("evl1_batch_scoring")
def evl1_batch_scoring(spark, d):
    """The scoring endpoint's flow with a real model: mail_subject rows with
    a valid label, scored by the MOD-1 model trained on mail."""
    model, _ = fit_logreg(spark, d)
    _, valid = scored_subject_mail(spark, d)
    valid = valid.drop("score", "y_pred", "conf").withColumnRenamed("text", "body")
    return M.score(model, valid).select("conv_id", "turn", "y_true", "y_pred", F.round("conf", 6).alias("conf"))
