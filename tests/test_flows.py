"""End-to-end flows (E1/E2/E3), streaming (STR-1/2) and the driver contract."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from mailsift.operators import evaluate as E
from mailsift.operators import models as M
from mailsift.sources import csv as C
from mailsift.sources import tables as tb


@pytest.fixture(scope="module")
def lr_model(spark):
    m = tb.mail(spark, SF001).withColumn("label", F.col("y").cast("double"))
    return M.logistic_regression_bow("body", "label", n_train=m.count(), max_iter=50).fit(m)


@pytest.fixture(scope="module")
def eval_csv(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("evalcsv"))
    C.write_csv(tb.mail_subject(spark, SF001).select("subject", "body", "label").coalesce(1), d)
    return d


def test_e2_evaluate_csv_report(spark, lr_model, eval_csv, tmp_dir):
    from mailsift.plans.flows import evaluate_csv

    rep = evaluate_csv(spark, eval_csv, lr_model, report_path=os.path.join(tmp_dir, "report"))
    assert rep["n_rows"] == tb.mail_subject(spark, SF001).count()
    m = rep["confusion_matrix"]["matrix"]
    assert sum(map(sum, m)) == rep["n_used_for_eval"]
    assert len(rep["examples_misclassified"]) <= 10
    idx = [e["index_in_valid"] for e in rep["examples_misclassified"]]
    assert idx == sorted(idx)


def test_str1_stream_equals_batch(spark, lr_model, eval_csv, tmp_dir):
    from mailsift.streaming import scoring as ST

    out = os.path.join(tmp_dir, "out")
    q = ST.score_stream(spark, eval_csv, lr_model, out, os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(out)
    batch = ST.score_rows(lr_model, ST.prepare_eval_rows(C.read_eval_csv(spark, eval_csv)))
    key = ["subject", "body", "label", "y_pred", "verdict"]
    assert sorted(repr(tuple(r)) for r in streamed.select(*key).collect()) == \
        sorted(repr(tuple(r)) for r in batch.select(*key).collect())


def test_str2_running_confusion_equals_batch_and_survives_replay(spark, lr_model, eval_csv, tmp_dir):
    from mailsift.streaming import scoring as ST

    out = os.path.join(tmp_dir, "counts")
    ST.running_confusion(spark, eval_csv, lr_model, out, os.path.join(tmp_dir, "ck2")).awaitTermination(300)
    batch = ST.score_rows(lr_model, ST.prepare_eval_rows(C.read_eval_csv(spark, eval_csv)))
    exp = {(r.y_true, r.y_pred): r.n for r in E.pair_counts(batch, "y_true", "y_pred").collect()}
    so_far = lambda: {(r.y_true, r.y_pred): r.n for r in ST.confusion_so_far(spark, out).collect()}
    assert so_far() == exp
    ST.count_batch(batch, out, 0)  # the batch again, as after a crash before its commit
    assert so_far() == exp
    ST.running_confusion(spark, eval_csv, lr_model, out, os.path.join(tmp_dir, "ck2")).awaitTermination(300)
    assert so_far() == exp


def test_arriving_files_are_read_by_their_own_headers(spark, tmp_path):
    from mailsift.streaming import scoring as ST

    (tmp_path / "a.csv").write_text("label,body,extra,subject\n1,b1,x,s1\n0,\"b\n2\",x,s2\n")
    (tmp_path / "b.CSV").write_text("subject,body,label\ns3,b3,phishing\n")
    (tmp_path / "c.txt").write_text("no mail")
    got = []
    q = ST._run(ST.arriving_files(spark, str(tmp_path)), lambda b, n: got.extend(map(tuple, ST.read_arrived(b).select("subject", "body", "label").collect())),
                str(tmp_path / "ck"), True)
    q.awaitTermination(120)
    assert sorted(got) == [("s1", "b1", "1"), ("s2", "b\n2", "0"), ("s3", "b3", "phishing")]
    (tmp_path / "d.csv").write_text("subject,label\ns,1\n")
    with pytest.raises(C.MissingColumnsError, match="body.*d.csv"):
        C.read_csv_by_name(spark, [str(tmp_path / "a.csv"), str(tmp_path / "d.csv")], ST.EVAL_COLUMNS)


def test_e3_classical(spark, tmp_dir):
    from mailsift.plans.flows import train_classical

    docs = tb.mail(spark, SF001)
    typed = docs.select(F.col("body").alias("Email Text"),
                        F.when(F.col("y") == 1, "Phishing Email").otherwise("Safe Email").alias("Email Type"))
    a, b, t = (os.path.join(tmp_dir, n) for n in ("a", "b", "t"))
    C.write_csv(typed.filter(F.col("Email Type") == "Safe Email").coalesce(1), a, C.LATIN1)
    C.write_csv(typed.coalesce(1), b, C.LATIN1)
    test = tb.mail_subject(spark, SF001).select("subject", "body", "label")
    C.write_csv(test.coalesce(1), t)
    res = train_classical(spark, [a, b], t, "tree")
    n_pos = docs.filter(F.col("y") == 1).select("body").distinct().count()
    assert res["n_train"] == 2 * n_pos
    assert 0.0 <= res["accuracy"] <= 1.0


def test_e1_train_and_evaluate(spark, tmp_dir):
    from mailsift.plans.flows import train_and_evaluate

    m = tb.mail_raw_label(spark, SF001)
    tr, te = os.path.join(tmp_dir, "tr"), os.path.join(tmp_dir, "te")
    C.write_csv(m.filter(F.col("row_id") % 5 != 0).select("body", "label").coalesce(1), tr, C.LATIN1)
    C.write_csv(m.filter(F.col("row_id") % 5 == 0).select("body", "label").coalesce(1), te, C.LATIN1)
    res = train_and_evaluate(spark, tr, te, os.path.join(tmp_dir, "out"), epochs=2, emb_dim=16)
    assert len(res["validation_accuracy"]) == 2
    assert "phishing" in res["labels"] and "legitimate" in res["labels"]
    rows = {r["row"]: r for r in res["report"]}
    assert "accuracy" in rows and "macro avg" in rows
    assert os.path.exists(os.path.join(tmp_dir, "out", "model"))

    from mailsift.plans.flows import evaluate_saved_model

    ev = evaluate_saved_model(spark, os.path.join(tmp_dir, "out"), te)
    rows = {r["row"]: r for r in ev["report"]}
    assert "accuracy" in rows and ev["n_skipped_unknown_label"] >= 0
    n_known = sum(r["support"] for k, r in rows.items() if k not in ("accuracy", "macro avg", "weighted avg"))
    assert n_known == rows["accuracy"]["support"]


def test_driver_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["word", "n"] and df.count() == 20
    qs, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(qs)
    families = {"agg", "cln", "evl", "fea", "lbl", "log", "mod", "prj", "shp", "snk", "src", "str", "udf"}
    for name in qs:
        if name == "pipeline" or re.match(r"op\d+_", name):  # parts that may be absent
            continue
        m = re.match(r"([a-z]+)\d+[a-e]?_", name)
        assert m and m.group(1) in families, name


def test_model_save_load_and_external_scorer(spark, lr_model, tmp_dir):
    import numpy as np
    from pyspark.sql import types as T

    from mailsift.sources import sinks as K

    path = os.path.join(tmp_dir, "model")
    K.save_model(lr_model, path)
    again = K.load_model(path)
    m = tb.mail(spark, SF001)
    a = {r.row_id: r.y_pred for r in M.score(lr_model, m).collect()}
    b = {r.row_id: r.y_pred for r in M.score(again, m).collect()}
    assert a == b

    def make_fn():
        def predict(x):  # a stand-in outside model: length-based score
            return (np.log1p(x) / 10.0).astype(np.float32)
        return predict

    scorer = M.external_scorer(make_fn, return_type=T.FloatType(), batch_size=16)
    out = m.select("row_id", scorer(F.length("body").cast("float")).alias("s")).collect()
    assert len(out) == m.count() and all(r.s is not None for r in out)


def test_write_splits_partitioned(spark, tmp_dir):
    from mailsift.operators import shape as S

    sp = S.stratified_split(tb.mail(spark, SF001), "y", "row_id")
    path = os.path.join(tmp_dir, "splits")
    S.write_splits(sp, path)
    back = spark.read.parquet(path)
    assert back.filter(F.col("split") == "test").count() == sp.filter(F.col("split") == "test").count()
    assert {"split=train", "split=val", "split=test"} <= set(os.listdir(path))


def test_explore_and_train_with_validation(spark, tmp_dir):
    from mailsift.plans.flows import explore, train_with_validation

    path = os.path.join(tmp_dir, "emails")
    C.write_csv(tb.mail(spark, SF001).select(F.col("body").alias("text"), F.col("y").alias("label")).coalesce(1), path)
    rep = explore(spark, path)
    n = tb.mail(spark, SF001).count()
    assert rep["shape_before"] == (n, 2) and sum(rep["rows_per_label"].values()) == rep["shape_after"][0]
    assert sum(rep["split_sizes"].values()) == rep["shape_after"][0]
    assert len(rep["top_words"][0]) <= 20 and {b["label"] for b in rep["special_characters"]} <= {0, 1}
    res = train_with_validation(spark, path, os.path.join(tmp_dir, "run"), epochs=2, emb_dim=8)
    assert len(res["f1_by_epoch"]) == 2 and res["validation"]["f1"] == max(res["f1_by_epoch"])
    assert set(res["validation"]) == {"accuracy", "precision", "recall", "f1"}
    assert res["split_sizes"]["val"] == res["split_sizes"]["test"]
