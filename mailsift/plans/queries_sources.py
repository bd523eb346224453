"""Source, sink and streaming queries (SRC-1/2/3/6/7/8/9, SNK-1/2/3/4, STR-1/2).

The driver ships Parquet only, so each query first writes data Spark derives
from the driver tables as CSV / JSON into the session's shared checkpoint
folder (never a machine-local path on a cluster), then reads it back with
the source under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailsift.functions import text as X
from mailsift.operators import features as FE
from mailsift.plans.queries_features import _SPLIT, _VOCAB, _split_mail
from mailsift.plans.queries_labels import _MAP_SQL, _UNION_LABELS, _union_label_map
from mailsift.plans.registry import register
from mailsift.session import shared_scratch
from mailsift.sources import csv as C
from mailsift.sources import json as J
from mailsift.sources import sinks as K
from mailsift.sources import tables as tb


def _scratch(spark, name: str) -> str:
    return shared_scratch(spark, f"queries/{name}-{uuid.uuid4().hex}")


@register("src1_read_latin1_csv", tb.with_views(
    "SELECT body, label FROM mail_raw_label WHERE body IS NOT NULL AND label IS NOT NULL", "mail_raw_label"))
def src1_read_latin1_csv(spark, d):
    path = _scratch(spark, "src1")
    C.write_csv(tb.mail_raw_label(spark, d).select("body", "label", "y"), path, C.LATIN1)
    return C.read_mail_csv(spark, path).select("body", "label")


@register("src2_read_text_csv", tb.with_views("SELECT body AS text, label FROM mail_subject", "mail_subject"))
def src2_read_text_csv(spark, d):
    path = _scratch(spark, "src2")
    C.write_csv(tb.mail_subject(spark, d).select(F.col("body").alias("text"), "label"), path, C.UTF8)
    return C.read_text_csv(spark, path).select("text", "label")


@register("src3_read_eval_csv", tb.with_views("SELECT subject, body, label FROM mail_subject", "mail_subject"))
def src3_read_eval_csv(spark, d):
    path = _scratch(spark, "src3")
    C.write_csv(tb.mail_subject(spark, d).select("subject", "body", "label"), path, C.UTF8)
    return C.read_eval_csv(spark, path).select("subject", "body", "label")


@register("src7_list_csv_files")
def src7_list_csv_files(spark, d):
    path = _scratch(spark, "src7")
    C.write_csv(tb.mail(spark, d).select("body", "y"), path, C.UTF8)
    return C.list_csv_files(spark, path)


@register("src8_label_map_roundtrip", tb.with_views(_MAP_SQL, "mail_raw_label", "mail_subject",
                                                    extra=[_UNION_LABELS]))
def src8_label_map_roundtrip(spark, d):
    """SNK-2 writes the label map as a JSON object, SRC-8 reads it back."""
    path = _scratch(spark, "src8")
    K.save_label_map(_union_label_map(spark, d)[1], path)
    return J.read_label_map(spark, path)


# The run metadata the training script records.
RUN_META = {"max_len": 256, "emb_dim": 128, "min_freq": 2, "remove_stopwords": False, "stem_tokens": False}
_META_FIELDS = ["emb_dim", "max_len", "min_freq", "n_labels", "n_train", "remove_stopwords", "stem_tokens",
                "vocab_size"]


@register("snk2_run_metadata_roundtrip", tb.with_views(
    "SELECT CAST(128 AS BIGINT) AS emb_dim, CAST(256 AS BIGINT) AS max_len, CAST(2 AS BIGINT) AS min_freq, "
    "(SELECT count(DISTINCT y) FROM splits WHERE split = 'train') AS n_labels, "
    "(SELECT count(*) FROM splits WHERE split = 'train') AS n_train, false AS remove_stopwords, "
    "false AS stem_tokens, (SELECT count(*) FROM vocab) AS vocab_size", "mail",
    extra=_SPLIT + [("vocab", _VOCAB)]))
def snk2_run_metadata_roundtrip(spark, d):
    """SNK-2: the run's hyper-parameters plus what the run measured (train
    rows, classes, vocabulary size) as one JSON document, read back."""
    path = _scratch(spark, "snk2")
    train = _split_mail(spark, d).filter(F.col("split") == "train")
    vocab = FE.build_vocab(train.withColumn("tokens", X.simple_tokens("body")), "tokens")
    figures = (train.agg(F.count(F.lit(1)).alias("n_train"), F.countDistinct("y").alias("n_labels"),
                         F.lit(None).cast("long").alias("vocab_size"))
               .unionByName(vocab.agg(F.lit(None).cast("long").alias("n_train"),
                                      F.lit(None).cast("long").alias("n_labels"),
                                      F.count(F.lit(1)).alias("vocab_size")))
               .agg(*[F.max(c).alias(c) for c in ("n_train", "n_labels", "vocab_size")]))
    meta = figures.select(*[F.lit(v).alias(k) for k, v in RUN_META.items()], "n_train", "n_labels", "vocab_size")
    K.save_meta_frame(meta, path)
    return spark.read.json(path).select(*_META_FIELDS)


@register("src6_required_columns", tb.with_views(
    "SELECT 'subject' AS column_name, count(*) - count(subject) AS n_missing FROM mail_subject "
    "UNION ALL SELECT 'body', count(*) - count(body) FROM mail_subject "
    "UNION ALL SELECT 'label', count(*) - count(label) FROM mail_subject", "mail_subject"))
def src6_required_columns(spark, d):
    """SRC-6 on an upload carrying extra columns: the required columns are
    checked (a missing one raises, naming all missing ones), then the
    upload's missing values are counted per required column."""
    path = _scratch(spark, "src6")
    C.write_csv(tb.mail_subject(spark, d), path, C.UTF8)
    required = ["subject", "body", "label"]
    up = C.require_columns(C.read_csv(spark, path), required)
    counts = up.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in required])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing"))
                                             for c in required])).alias("m")).select("m.*")


@register("snk1_vocab_roundtrip", tb.with_views("SELECT token, id FROM vocab", "mail",
                                                extra=_SPLIT + [("vocab", _VOCAB)]))
def snk1_vocab_roundtrip(spark, d):
    """SNK-1 writes Parquet + a {token: id} JSON document; read the JSON back."""
    path = _scratch(spark, "snk1")
    train = _split_mail(spark, d).filter(F.col("split") == "train").withColumn("tokens", X.simple_tokens("body"))
    K.save_vocab(FE.build_vocab(train, "tokens"), path)
    text = spark.read.text(f"{path}/vocab.json", wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,long>")).alias("token", "id"))


@register("src9_training_log_roundtrip", tb.with_views(
    "SELECT step, epoch, loss, eval_loss, eval_accuracy FROM log", "log"))
def src9_training_log_roundtrip(spark, d):
    """The log table written as trainer-state documents (SNK), read back
    with SRC-9."""
    path = _scratch(spark, "src9")
    K.save_training_log(tb.log(spark, d).select("step", "epoch", "loss", "eval_loss", "eval_accuracy"), path)
    return J.read_training_log(spark, path, multi_line=False).select("step", "epoch", "loss", "eval_loss",
                                                                     "eval_accuracy")


def _small_model(spark, d):
    """The bag-of-words model on the labelled mail, for the sink and streams below."""
    from mailsift.operators import models as M
    m = tb.mail(spark, d).withColumn("label", F.col("y").cast("double"))
    n = m.count()
    return M.logistic_regression_bow("body", "label", n_train=n).fit(M.for_fit(m))


@register("snk3_model_roundtrip")
def snk3_model_roundtrip(spark, d):
    """SNK-3: save the fitted pipeline, load it back, score with the copy."""
    from mailsift.operators import models as M
    path = _scratch(spark, "snk3")
    K.save_model(_small_model(spark, d), path)
    scored = M.score(K.load_model(path), tb.mail(spark, d))
    return scored.select("row_id", "y", "y_pred", F.round("conf", 6).alias("conf"))


def _report_sql():
    from mailsift.plans.queries_eval import _VALID_SQL
    return tb.with_views(
        "SELECT (SELECT count(*) FROM mail_subject) AS n_rows, count(*) AS n_used_for_eval, "
        "round_even(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy, "
        "count(CASE WHEN y_true <> y_pred THEN 1 END) AS n_errors FROM v", "mail_subject", extra=[_VALID_SQL])


@register("snk4_report_roundtrip", _report_sql())
def snk4_report_roundtrip(spark, d):
    """SNK-4: the nested evaluation report written as one JSON document and
    read back (n_errors is the full confusion off-diagonal)."""
    from mailsift.operators import evaluate as E
    from mailsift.plans.queries_eval import scored_subject_mail
    m, v = scored_subject_mail(spark, d)
    path = _scratch(spark, "snk4")
    K.save_report(spark, E.evaluation_frame(v, m, ("conv_id", "turn")), path)
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", E.REPORT_JSON_SCHEMA).alias("r"))
    cm = F.col("r.confusion_matrix.matrix")
    off = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(cm) - 1),
                                  lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), F.size(cm[i]) - 1),
                                                                    lambda j: F.when(i != j, cm[i][j]).otherwise(0)),
                                                        F.lit(0).cast("long"), lambda a, x: a + x)),
                      F.lit(0).cast("long"), lambda a, x: a + x)
    return doc.select(F.col("r.n_rows").alias("n_rows"), F.col("r.n_used_for_eval").alias("n_used_for_eval"),
                      F.col("r.accuracy").alias("accuracy"), off.alias("n_errors"))


def _arriving_files(spark, d, name):
    """mail_subject written as several CSV files: the arriving uploads."""
    folder = _scratch(spark, name)
    C.write_csv(tb.mail_subject(spark, d).select("subject", "body", "label"), folder)
    return folder


def _valid_by_class():
    from mailsift.plans.queries_eval import _VALID_SQL
    return _VALID_SQL


@register("str1_stream_scoring", tb.with_views("SELECT y_true, count(*) AS n FROM v GROUP BY y_true", "mail_subject", extra=[_valid_by_class()]))
def str1_stream_scoring(spark, d):
    """STR-1: arriving CSVs -> scored, thresholded rows (availableNow run);
    the rows scored of each class, every one with a score and its verdict."""
    from mailsift.streaming import scoring as ST
    model = _small_model(spark, d)
    out = _scratch(spark, "str1-out")
    q = ST.score_stream(spark, _arriving_files(spark, d, "str1-in"), model, out, _scratch(spark, "str1-ckpt"))
    q.awaitTermination()
    scored = spark.read.parquet(out).where("score BETWEEN 0 AND 1 AND verdict = IF(score >= 0.5, 'phishing', 'legitimate')")
    return scored.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))


@register("str2_running_confusion")
def str2_running_confusion(spark, d):
    """STR-2: confusion counts kept in a durable table, batch by batch."""
    from mailsift.streaming import scoring as ST
    model = _small_model(spark, d)
    out = _scratch(spark, "str2-out")
    q = ST.running_confusion(spark, _arriving_files(spark, d, "str2-in"), model, out, _scratch(spark, "str2-ckpt"), max_files_per_trigger=4)
    q.awaitTermination()
    return ST.confusion_so_far(spark, out)


@register("str2_merged_batches", tb.with_views("SELECT y AS y_true, y_pred, count(*) AS n FROM pred GROUP BY y, y_pred", "mail", "pred"))
def str2_merged_batches(spark, d):
    """STR-2's table: the scored mail in seven batches, the third of which runs twice."""
    from mailsift.streaming import scoring as ST
    out = _scratch(spark, "str2-merge")
    pred = tb.pred(spark, d).withColumnRenamed("y", "y_true")
    for number in (0, 1, 2, 2, 3, 4, 5, 6):
        ST.count_batch(pred.where(F.pmod(F.xxhash64("row_id"), F.lit(7)) == number), out, number)
    return ST.confusion_so_far(spark, out)
