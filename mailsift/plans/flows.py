"""End-to-end flows of the original tools, as Spark jobs.

* ``train_and_evaluate`` (E1): train CSV + test CSV -> clean -> labels ->
  label map over both -> vocabulary (train only) -> encoded ids -> one training
  run, best epoch by a validation split -> report -> saved assets.
* ``evaluate_csv`` (E2): an evaluation upload -> report, given a model.
* ``train_classical`` (E3): several training CSVs -> dedup (first wins) ->
  balance -> bag-of-words model -> accuracy and report on a test CSV.
* ``evaluate_saved_model``: a model saved by E1 on a new CSV -> labels by
  their printed form -> rows with unseen labels counted and skipped -> report.
* ``explore``: the notebook's data exploration -> shapes, class counts,
  special-character box statistics, top and class-unique words, 70/10/20
  split sizes.
* ``train_with_validation``: UTF-8 CSV -> stratified train/val/test ->
  truncated/padded tokens -> best epoch by macro F1 -> its metrics on the validation rows.

Intermediate tables are handed off as Parquet in the session's shared
checkpoint folder (cleaning runs once, lineage is cut, and a lost executor
only recomputes from the last written table); they are deleted when a flow ends.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators import evaluate as E
from mailsift.operators import features as FE
from mailsift.operators import labels as L
from mailsift.operators import models as M
from mailsift.operators import profile as PR
from mailsift.operators import shape as S
from mailsift.session import clears_handoffs, handoff
from mailsift.sources import csv as C
from mailsift.sources import json as J
from mailsift.sources import sinks as K


def clean_mail(df: DataFrame, text: str = "body", remove_stopwords: bool = False, stem: bool = False,
               partitions: int | None = None) -> DataFrame:
    """CLN-13 over a table. Rows are spread evenly before the Arrow step so
    long mails do not pile up in a few tasks (SURVEY H8)."""
    if partitions:
        df = df.repartition(partitions)
    return df.withColumn(text, X.clean_text(X.coerce_text(df, text), remove_stopwords=remove_stopwords, stem=stem))


def with_ids(df: DataFrame, vocab: DataFrame, max_len: int, *cols: str) -> DataFrame:
    """The model's input as a written table: the ids of FEA-2 (the first
    ``max_len`` tokens over ``vocab``) and their words, and ``cols`` of ``df``."""
    ids = FE.encode_ids(df, "_row_ord", "tokens", vocab, max_len)
    return handoff(df.select("_row_ord", *cols).join(ids, "_row_ord").withColumn("words", M.id_words("ids")), "ids")


@clears_handoffs
def train_and_evaluate(spark: SparkSession, train_path: str, test_path: str, out_dir: str,
                       epochs: int = 10, max_len: int = 256, min_freq: int = 2,
                       emb_dim: int = 128, remove_stopwords: bool = False, stem_tokens: bool = False,
                       seed: int = 42) -> dict:
    """E1. One training run of ``epochs`` epochs under ``out_dir/run``; the best
    epoch on the validation split is kept (latest among ties) and reported on the
    test file. A run that was cut short goes on from its last epoch."""
    train = C.read_mail_csv(spark, train_path)
    test = C.read_mail_csv(spark, test_path)
    train = handoff(L.normalize_labels(clean_mail(train, "body", remove_stopwords, stem_tokens), "label"),
                    "train_clean")
    test = handoff(L.normalize_labels(clean_mail(test, "body", remove_stopwords, stem_tokens), "label"),
                   "test_clean")
    label_map = L.build_label_map(train, test)
    label2id = {r["label"]: r["label_id"] for r in label_map.collect()}  # one row per class
    train = L.encode_labels(train, label_map, "label", "label_id").withColumn("label_id", F.col("label_id").cast("double"))
    test = L.encode_labels(test, label_map, "label", "label_id").withColumn("label_id", F.col("label_id").cast("double"))
    # Second cleaning pass for tokens (the body is already cleaned once).
    tok = X.clean_tokens("body", normalize=False)
    train, test = train.withColumn("tokens", tok), test.withColumn("tokens", tok)
    vocab = handoff(FE.build_vocab(train, "tokens", min_freq), "vocab")
    train, test = (with_ids(df, vocab, max_len, "label_id") for df in (train, test))
    parts = S.stratified_split(train, "label_id", "_row_ord", 0.1, 1.0, seed)
    fit_rows, val_rows = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") != "train")

    def val_accuracy(scored: DataFrame) -> float:
        return E.accuracy(scored, "label_id", "y_pred").first()[0] or 0.0

    model, metrics = M.fit_epochs(fit_rows, val_rows, f"{out_dir}/run", epochs, val_accuracy, "words", "label_id",
                                  len(label2id), emb_dim, seed=seed)
    scores = [r["metric"] for r in metrics.orderBy("epoch").collect()]
    scored = M.score(model, test)
    id2label = {v: k for k, v in label2id.items()}
    report = E.classification_report(scored, sorted(id2label), id2label, "label_id", "y_pred").collect()
    K.save_vocab(vocab, f"{out_dir}/vocab")
    K.save_label_map(label_map, f"{out_dir}/labels.json")
    K.save_meta(spark, {"max_len": max_len, "emb_dim": emb_dim, "min_freq": min_freq,
                        "remove_stopwords": remove_stopwords, "stem_tokens": stem_tokens}, f"{out_dir}/meta.json")
    K.save_model(model, f"{out_dir}/model")
    test.select("_row_ord", "ids").write.mode("overwrite").parquet(f"{out_dir}/test_ids.parquet")
    return {"labels": label2id, "validation_accuracy": scores, "report": [r.asDict() for r in report]}


@clears_handoffs
def evaluate_csv(spark: SparkSession, path: str, model, id2label: Mapping[int, str] | None = None,
                 text_col: str = "body", report_path: str | None = None) -> dict:
    """E2: the evaluation upload -> nested report (EVL-9)."""
    id2label = dict(P.DEFAULT_ID2LABEL if id2label is None else id2label)
    label2id = {v: k for k, v in id2label.items()}
    raw = C.read_eval_csv(spark, path)
    n_rows = raw.count()
    t = raw.withColumn("text", X.subject_body_block("subject", "body"))
    t = L.label_ids(t, "label", label2id).filter(F.col("y_true").isNotNull())
    scored = M.score(model, t.withColumn(text_col, F.col("text")))
    # The report reads its rows twice (first errors, then counts): score once.
    scored = handoff(scored.select("_row_ord", "y_true", "y_pred", "conf", "text"), "scored")
    rep = E.evaluation_report(scored, n_rows, ("_row_ord",), "y_true", "y_pred", "conf", "text", id2label)
    if report_path:
        K.save_report(spark, rep, report_path)
    return rep


@clears_handoffs
def train_classical(spark: SparkSession, train_paths: Sequence[str], test_path: str, model: str = "tree",
                    seed: int = 42) -> dict:
    """E3: multi-file training set, first-wins dedup on the text, balanced
    classes, bag-of-words model, accuracy and report on a test file."""
    df = C.read_csv_files(spark, train_paths).dropna(subset=["Email Text", "Email Type"])
    df = S.drop_duplicates_first(df, ["Email Text"], ["_file_ord", "_row_ord"])
    df = df.withColumn("_key", F.concat_ws(":", "_file_ord", "_row_ord"))
    bal = S.balance_classes(df, "Email Type", "_key", ("Safe Email", "Phishing Email"), seed)
    bal = bal.withColumn("label", L.binary_label("Email Type", "Phishing Email").cast("double"))
    test = C.read_eval_csv(spark, test_path)
    test = test.withColumn("Email Text", X.subject_body_space("subject", "body")).dropna(subset=["label"])
    test = test.withColumn("y", L.binary_label("label", "phishing"))
    n_train = bal.count()
    if model == "tree":
        pipe = M.decision_tree_bow("Email Text", "label")
    else:
        pipe = M.logistic_regression_bow("Email Text", "label", n_train=n_train)
    fitted = pipe.fit(M.for_fit(bal))
    scored = M.score(fitted, test)
    names = {0: "Legitimate", 1: "Phishing"}
    acc = E.accuracy(scored, "y", "y_pred").first()[0]
    report = E.classification_report(scored, [0, 1], names, "y", "y_pred").collect()
    return {"accuracy": acc, "report": [r.asDict() for r in report], "n_train": n_train}


@clears_handoffs
def evaluate_saved_model(spark: SparkSession, model_dir: str, test_path: str) -> dict:
    """SRC-1 -> LBL-2 -> PRJ-8 -> EVL-1 -> EVL-8 with the assets E1 saved
    (model, label map, run metadata)."""
    model = K.load_model(f"{model_dir}/model")
    label_map = J.read_label_map(spark, f"{model_dir}/labels.json")
    meta = json.loads(K.read_document(spark, f"{model_dir}/meta.json"))
    df = C.read_mail_csv(spark, test_path)
    df = df.withColumn("label", L.normalize_label_printed("label", L.label_kind(df, "label")))
    n_unknown = L.unknown_label_count(df, label_map).first()[0]
    df = L.encode_labels(L.keep_known_labels(df, label_map), label_map, "label", "label_id", strict=False)
    df = clean_mail(df, "body", meta.get("remove_stopwords", False), meta.get("stem_tokens", False))
    df = df.withColumn("tokens", X.clean_tokens("body", normalize=False)).withColumn("label_id", F.col("label_id").cast("double"))
    vocab = spark.read.parquet(f"{model_dir}/vocab/vocab.parquet")
    scored = M.score(model, with_ids(df, vocab, meta["max_len"], "label_id"))
    id2label = {int(r["label_id"]): r["label"] for r in label_map.collect()}
    report = E.classification_report(scored, sorted(id2label), id2label, "label_id", "y_pred").collect()
    return {"n_skipped_unknown_label": int(n_unknown), "report": [r.asDict() for r in report]}


def _numeric_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.trim(F.col(label).cast("string")).try_cast("double").cast("int"))


@clears_handoffs
def explore(spark: SparkSession, path: str, text: str = "text", label: str = "label", k: int = 20,
            seed: int = 42) -> dict:
    """SRC-5, AGG-8, PRJ-5, AGG-1 ... AGG-6, SHP-5 as one report (every part
    is a small aggregate; only those reach the driver)."""
    raw = C.read_csv(spark, path)
    data_cols = [c for c in raw.columns if not c.startswith("_")]
    before = PR.null_shape(raw.select(*data_cols)).first()
    df = _numeric_label(raw.dropna(how="any", subset=data_cols), label).withColumn(text, F.lower(text))
    df = df.filter(F.col(label).isNotNull())
    counts = {r[label]: r["n"] for r in PR.rows_per_label(df, label).collect()}
    box = [r.asDict() for r in PR.box_stats(PR.with_special_chars(df, text), "special_characters", label).collect()]
    top = {c: [(r.word, r.n) for r in PR.top_words(df.filter(F.col(label) == c), text, k).collect()] for c in (0, 1)}
    unique = [(r.word, r.n) for r in PR.class_unique_words(df, label, 1, text, k).collect()]
    parts = S.stratified_split(df.withColumn("_key", F.col("_row_ord")), label, "_key", 0.3, 2 / 3, seed)
    sizes = {r.split: r.n for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"shape_before": (before["n_rows"], len(data_cols)), "shape_after": (df.count(), len(data_cols)),
            "rows_per_label": counts, "special_characters": box, "top_words": top, "unique_words": unique,
            "split_sizes": sizes}


@clears_handoffs
def train_with_validation(spark: SparkSession, path: str, out_dir: str, test_size: float = 0.1, val_size: float = 0.1,
                          max_len: int = 256, epochs: int = 5, emb_dim: int = 128, seed: int = 42) -> dict:
    """The secondary training script: SRC-2 -> SHP-4 -> FEA-5 -> epochs on the
    truncated tokens, padding left out of their mean -> the epoch with the best
    macro F1 on the validation rows (MOD-5) -> EVL-6 of it on them."""
    df = _numeric_label(C.read_text_csv(spark, path), "label").filter(F.col("label").isNotNull())
    rel_val = val_size / (test_size + val_size)
    parts = S.stratified_split(df.withColumn("_key", F.col("_row_ord")), "label", "_key",
                               test_size + val_size, 1 - rel_val, seed)
    parts = parts.withColumn("tokens", X.simple_tokens("text"))
    parts = FE.truncate_pad(parts, "tokens", "split", max_len)
    parts = handoff(parts.select("split", "label", F.filter("padded", lambda t: t != FE.PAD).alias("words")), "padded")
    labels = sorted(r[0] for r in parts.select("label").distinct().collect())
    # Classes by their place among the labels, as the network numbers them.
    place = F.array_position(F.array(*(F.lit(v) for v in labels)), F.col("label")) - 1
    parts = parts.withColumn("y", place.cast("double"))
    ids = list(range(len(labels)))

    def validation(scored: DataFrame) -> dict:
        return {r.metric: r.value for r in E.metric_rows(scored, ids, "y", "y_pred", "macro").collect()}

    val = parts.filter(F.col("split") == "val")
    model, metrics = M.fit_epochs(parts.filter(F.col("split") == "train"), val, f"{out_dir}/run", epochs,
                                  lambda scored: validation(scored)["f1"] or 0.0, "words", "y", len(labels), emb_dim, seed=seed)
    return {"split_sizes": {r.split: r.n for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()},
            "f1_by_epoch": [r["metric"] for r in metrics.orderBy("epoch").collect()],
            "validation": validation(M.score(model, val))}
