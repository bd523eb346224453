"""Evaluation queries: EVL-2 ... EVL-13 on a deterministic pseudo-score.

``pred`` scores labelled mail without a model (see ``sources.tables``), so
every metric has an exact SQL oracle. EVL-9 / EVL-10 run the scoring
endpoint's flow on ``mail_subject``: subject + body, label ids, valid rows,
a length-derived score, the report.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators import evaluate as E
from mailsift.operators import labels as L
from mailsift.plans.queries_labels import DEFAULT_LABEL2ID, _ids_sql, _strip_sql
from mailsift.plans.registry import register
from mailsift.sources import tables as tb

LABELS = sorted(P.DEFAULT_ID2LABEL)
NAMES = P.DEFAULT_ID2LABEL
_LAB_SQL = ("lab", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in NAMES.items())
            + ") t(class_id, class_name)")
_COUNTS_SQL = ("c", "SELECT y AS y_true, y_pred, count(*) AS n FROM pred GROUP BY y, y_pred")
_PC_SQL = ("pc", """
SELECT class_id, class_name, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
       CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1,
       CAST(support AS BIGINT) AS support
FROM (SELECT class_id, class_name,
             CAST(coalesce((SELECT sum(n) FROM c WHERE c.y_true = lab.class_id), 0) AS DOUBLE) AS support,
             CAST(coalesce((SELECT sum(n) FROM c WHERE c.y_pred = lab.class_id), 0) AS DOUBLE) AS predicted,
             CAST(coalesce((SELECT sum(n) FROM c WHERE c.y_true = lab.class_id AND c.y_pred = lab.class_id), 0)
                  AS DOUBLE) AS tp
      FROM lab)""")
_PC = [_LAB_SQL, _COUNTS_SQL, _PC_SQL]
_LOGITS_SQL = ("lg", """
SELECT row_id, y, l0, l1, exp(l0 - greatest(l0, l1)) AS e0, exp(l1 - greatest(l0, l1)) AS e1
FROM (SELECT row_id, y, 3 * (1 - score) AS l0, 3 * score AS l1 FROM pred)""")


def _r(c, n=9):
    return F.round(c, n)


def _with_logits(spark, d):
    p = tb.pred(spark, d).withColumn("logits", F.array(3 * (1 - F.col("score")), 3 * F.col("score")))
    return E.with_predictions(p, "logits", "probs", "y_hat", "p_max")


@register("evl2_softmax_argmax", tb.with_views(
    "SELECT row_id, round(e1 / (e0 + e1), 9) AS p1, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS y_hat, "
    "round(greatest(e0, e1) / (e0 + e1), 9) AS conf FROM lg", "pred", extra=[_LOGITS_SQL]))
def evl2_softmax_argmax(spark, d):
    p = _with_logits(spark, d)
    return p.select("row_id", _r(F.col("probs")[1]).alias("p1"), "y_hat", _r(F.col("p_max")).alias("conf"))


@register("evl3_accuracy", tb.with_views(
    "SELECT round(avg(CASE WHEN y = y_pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred", "pred"))
def evl3_accuracy(spark, d):
    return E.accuracy(tb.pred(spark, d), "y", "y_pred").select(_r(F.col("accuracy")).alias("accuracy"))


@register("evl4_confusion_matrix", tb.with_views("""
SELECT g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT a.class_id AS y_true, b.class_id AS y_pred FROM lab a, lab b) g
LEFT JOIN c ON g.y_true = c.y_true AND g.y_pred = c.y_pred""", "pred", extra=[_LAB_SQL, _COUNTS_SQL]))
def evl4_confusion_matrix(spark, d):
    return E.confusion_matrix(tb.pred(spark, d), LABELS, "y", "y_pred")


@register("evl5_per_class", tb.with_views(
    "SELECT class_id, class_name, round(precision, 9) AS precision, round(recall, 9) AS recall, "
    "round(f1, 9) AS f1, support FROM pc", "pred", extra=_PC))
def evl5_per_class(spark, d):
    pc = E.per_class(tb.pred(spark, d), LABELS, NAMES, "y", "y_pred")
    return pc.select("class_id", "class_name", _r(F.col("precision")).alias("precision"),
                     _r(F.col("recall")).alias("recall"), _r(F.col("f1")).alias("f1"), "support")


@register("evl6_macro_average", tb.with_views(
    "SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 "
    "FROM pc", "pred", extra=_PC))
def evl6_macro_average(spark, d):
    m = E.macro_average(E.per_class(tb.pred(spark, d), LABELS, NAMES, "y", "y_pred"))
    return m.select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register("evl6_metric_callback", tb.with_views(
    "SELECT 'accuracy' AS metric, round(avg(CASE WHEN y = y_pred THEN 1.0 ELSE 0.0 END), 9) AS value FROM pred "
    "UNION ALL SELECT 'precision', round(avg(precision), 9) FROM pc "
    "UNION ALL SELECT 'recall', round(avg(recall), 9) FROM pc "
    "UNION ALL SELECT 'f1', round(avg(f1), 9) FROM pc", "pred", extra=_PC))
def evl6_metric_callback(spark, d):
    m = E.metric_rows(tb.pred(spark, d), LABELS, "y", "y_pred", "macro")
    return m.select("metric", _r(F.col("value")).alias("value"))


@register("evl7_binary_scores", tb.with_views(
    "SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pc "
    "WHERE class_id = 1", "pred", extra=_PC))
def evl7_binary_scores(spark, d):
    b = E.binary_scores(E.per_class(tb.pred(spark, d), LABELS, NAMES, "y", "y_pred"), 1)
    return b.select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register("evl8_classification_report", tb.with_views("""
SELECT class_name AS row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL,
       round(CAST(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS DOUBLE) / sum(n), 9), CAST(sum(n) AS BIGINT)
FROM c
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
       CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
       CAST(sum(support) AS BIGINT) FROM pc""", "pred", extra=_PC))
def evl8_classification_report(spark, d):
    r = E.classification_report(tb.pred(spark, d), LABELS, NAMES, "y", "y_pred")
    return r.select("row", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


# ----------------------------------------------------------- EVL-9 / EVL-10
_SCORE = "CAST((length(text) * 37) % 101 AS DOUBLE) / 100.0"
_SUBJ_TEXT = _strip_sql("coalesce(subject, '') || chr(10) || chr(10) || coalesce(body, '')")
_VALID_SQL = ("v", f"""
SELECT conv_id, turn, text, y_true, CAST(score >= 0.5 AS INTEGER) AS y_pred, greatest(score, 1 - score) AS conf
FROM (SELECT conv_id, turn, text, y_true, {_SCORE} AS score FROM (
        SELECT conv_id, turn, {_SUBJ_TEXT} AS text, {_ids_sql('label')} AS y_true FROM mail_subject))
WHERE y_true IS NOT NULL""")


def scored_subject_mail(spark, d):
    """The scoring endpoint's input side on ``mail_subject``: text, label id,
    valid rows, and a deterministic score standing in for the model."""
    m = tb.mail_subject(spark, d)
    t = m.select("conv_id", "turn", X.subject_body_block("subject", "body").alias("text"), "label")
    t = L.label_ids(t, "label", DEFAULT_LABEL2ID)
    score = ((F.length("text") * 37) % 101).cast("double") / 100.0
    v = t.filter(F.col("y_true").isNotNull()).withColumn("score", score)
    v = v.withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))
    return m, v.withColumn("conf", F.greatest("score", 1 - F.col("score")))


def _cells():
    return [(a, b) for a in LABELS for b in LABELS]


@register("evl9_evaluation_report", tb.with_views(
    "SELECT (SELECT count(*) FROM mail_subject) AS n_rows, count(*) AS n_used_for_eval, "
    "round_even(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy, "
    + ", ".join(f"count(CASE WHEN y_true = {a} AND y_pred = {b} THEN 1 END) AS cm_{a}{b}" for a, b in _cells())
    + " FROM v", "mail_subject", extra=[_VALID_SQL]))
def evl9_evaluation_report(spark, d):
    m, v = scored_subject_mail(spark, d)
    rep = E.evaluation_frame(v, m, ("conv_id", "turn"))
    cells = [F.col("confusion_matrix.matrix")[i][j].alias(f"cm_{a}{b}")
             for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)]
    return rep.select("n_rows", "n_used_for_eval", "accuracy", *cells)


@register("evl9_per_class_report", tb.with_views(
    "SELECT class_id, class_name, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, "
    "round_even(f1, 4) AS f1, support FROM pc", "mail_subject", extra=[
        _VALID_SQL, _LAB_SQL, ("c", "SELECT y_true, y_pred, count(*) AS n FROM v GROUP BY y_true, y_pred"), _PC_SQL]))
def evl9_per_class_report(spark, d):
    _, v = scored_subject_mail(spark, d)
    return E.evaluation_frame(v, None, ("conv_id", "turn")).select(F.inline("per_class"))


@register("evl10_misclassified_examples", tb.with_views("""
SELECT index_in_valid, CASE y_true WHEN 0 THEN 'legitimate' WHEN 1 THEN 'phishing' END AS "true",
       CASE y_pred WHEN 0 THEN 'legitimate' WHEN 1 THEN 'phishing' END AS pred,
       round_even(conf, 4) AS confidence, substring(text, 1, 300) AS preview
FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS index_in_valid FROM v)
WHERE y_true <> y_pred ORDER BY index_in_valid LIMIT 10""", "mail_subject", extra=[_VALID_SQL]))
def evl10_misclassified_examples(spark, d):
    _, v = scored_subject_mail(spark, d)
    return E.misclassified(v, ["conv_id", "turn"])


# ----------------------------------------------------------- EVL-11 ... 13
@register("evl11_epoch_metrics", tb.with_views("""
SELECT CAST(ceil(epoch) AS BIGINT) AS epoch, round(sum(loss * batch_size) / sum(batch_size), 9) AS loss,
       round(CAST(sum(n_correct) AS DOUBLE) / sum(batch_size), 9) AS accuracy
FROM log WHERE loss IS NOT NULL AND epoch IS NOT NULL GROUP BY 1""", "log"))
def evl11_epoch_metrics(spark, d):
    batches = tb.log(spark, d).filter(F.col("loss").isNotNull() & F.col("epoch").isNotNull())
    m = E.epoch_metrics(batches.withColumn("epoch", F.ceil("epoch").cast("long")), "epoch", "loss", "batch_size",
                        "n_correct")
    return m.select("epoch", _r(F.col("loss")).alias("loss"), _r(F.col("accuracy")).alias("accuracy"))


@register("evl12_cross_entropy", tb.with_views("""
SELECT round(avg(nll), 9) AS cross_entropy, round(sum(weight * nll) / sum(weight), 9) AS cross_entropy_weighted
FROM (SELECT y, -ln(CASE WHEN y = 1 THEN e1 ELSE e0 END / (e0 + e1)) AS nll FROM lg) p
JOIN (SELECT y AS label, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight
      FROM (SELECT y, count(*) AS n FROM pred GROUP BY y)) w ON p.y = w.label""", "pred", extra=[_LOGITS_SQL]))
def evl12_cross_entropy(spark, d):
    p = _with_logits(spark, d)
    w = L.class_weights(tb.pred(spark, d), "y").withColumnRenamed("y", "label")
    ce = E.cross_entropy(p, "y", "probs", w)
    return ce.select(_r(F.col("cross_entropy")).alias("cross_entropy"),
                     _r(F.col("cross_entropy_weighted")).alias("cross_entropy_weighted"))


@register("evl13_threshold_sweep", tb.with_views("""
SELECT t, n_flagged, tp, round(CASE WHEN n_flagged > 0 THEN CAST(tp AS DOUBLE) / n_flagged ELSE 0.0 END, 9) AS precision,
       round(CASE WHEN total_pos > 0 THEN CAST(tp AS DOUBLE) / total_pos ELSE 0.0 END, 9) AS recall
FROM (SELECT t, count(CASE WHEN score >= CAST(t AS DOUBLE) / 100 THEN 1 END) AS n_flagged,
             count(CASE WHEN score >= CAST(t AS DOUBLE) / 100 AND y = 1 THEN 1 END) AS tp,
             count(CASE WHEN y = 1 THEN 1 END) AS total_pos
      FROM pred, (SELECT range AS t FROM range(0, 101)) g GROUP BY t)""", "pred"))
def evl13_threshold_sweep(spark, d):
    s = E.threshold_sweep(tb.pred(spark, d), "score", "y", 1, 100)
    return s.select("t", "n_flagged", "tp", _r(F.col("precision")).alias("precision"),
                    _r(F.col("recall")).alias("recall"))
