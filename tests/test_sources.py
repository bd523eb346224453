"""Sources and sinks (SRC-*, SNK-*)."""

import json
import os

import pytest

from mailsift.sources import csv as C
from mailsift.sources import json as J
from mailsift.sources import sinks as K


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_latin1_multiline_quotes_and_na(spark, tmp_dir):
    p = os.path.join(tmp_dir, "train.csv")
    _write(p, 'body,label,extra\n"caf\xe9 ""quoted""\nsecond line",1,x\nplain,NA,y\n,0,z\nok,spam,w\n',
           encoding="latin-1")
    rows = C.read_mail_csv(spark, p).orderBy("_row_ord").collect()
    assert [(r.body, r.label) for r in rows] == [('café "quoted"\nsecond line', "1"), ("ok", "spam")]


def test_missing_columns_listed(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.csv")
    _write(p, "subject,text\na,b\n")
    with pytest.raises(C.MissingColumnsError) as e:
        C.read_eval_csv(spark, p)
    assert e.value.missing == ["body", "label"]


def test_text_csv_keeps_nulls_and_union_by_name(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "b.csv")
    _write(a, "text,label\nx,1\n,0\n")
    _write(b, "label,text,more\n1,y,z\n")
    assert C.read_text_csv(spark, a).count() == 2
    u = C.read_csv_files(spark, [a, b]).orderBy("_file_ord", "_row_ord").collect()
    assert [(r.text, r.label, r.more, r._file_ord) for r in u] == [("x", "1", None, 0), (None, "0", None, 0),
                                                                     ("y", "1", "z", 1)]
    assert C.read_csv_complete(spark, a).count() == 1


def test_row_order_follows_files_then_rows(spark, tmp_dir):
    """Files of a folder by name, whatever their sizes (Spark starts with the
    largest) and names; rows as they stand in a file."""
    folder = os.path.join(tmp_dir, "many files")
    os.mkdir(folder)
    want = []
    for name, n in (("a b.csv", 2), ("b%20.csv", 400), ("c.csv", 30), ("d\u00e9.csv", 1)):
        rows = [(f"{name} {i}\nline", str(i)) for i in range(n)]
        _write(os.path.join(folder, name), "text,label\n" + "".join(f'"{t}",{y}\n' for t, y in rows))
        want += rows
    got = C.read_text_csv(spark, folder).orderBy("_row_ord").collect()
    assert [(r.text, r.label) for r in got] == want
    assert len({r._row_ord for r in got}) == len(want)


def test_list_csv_files(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "a.CSV"), "x\n" + "1\n" * 600)
    _write(os.path.join(tmp_dir, "b.txt"), "x\n")
    rows = C.list_csv_files(spark, tmp_dir).collect()
    assert [r.name for r in rows] == ["a.CSV"] and rows[0].size_kb == pytest.approx(1.2, abs=0.1)


def test_label_map_and_training_log(spark, tmp_dir):
    lp = os.path.join(tmp_dir, "labels.json")
    _write(lp, json.dumps({"legitimate": 0, "phishing": 1}))
    assert sorted(tuple(r) for r in J.read_label_map(spark, lp).collect()) == [("legitimate", 0), ("phishing", 1)]
    state = {"best_metric": None, "log_history": [
        {"epoch": 1.397, "grad_norm": 0.00273, "learning_rate": 2.677e-05, "loss": 0.0428, "step": 500},
        {"epoch": 2.0, "eval_loss": 0.1, "eval_accuracy": 0.9, "step": 716},
        {"epoch": 2.793, "loss": 0.0066, "step": 1000}]}
    sp = os.path.join(tmp_dir, "trainer_state.json")
    _write(sp, json.dumps(state, indent=2))
    log = J.read_training_log(spark, sp).orderBy("ord").collect()
    assert [r.loss for r in log] == [0.0428, None, 0.0066]
    assert [r.eval_accuracy for r in log] == [None, 0.9, None]


def test_sinks_roundtrip(spark, tmp_dir):
    vocab = spark.createDataFrame([("<pad>", 0, 0), ("<unk>", 0, 1), ("hi", 3, 2)], "token string, freq long, id long")
    K.save_vocab(vocab, os.path.join(tmp_dir, "v"))
    assert json.loads(K.read_document(spark, os.path.join(tmp_dir, "v", "vocab.json"))) == \
        {"<pad>": 0, "<unk>": 1, "hi": 2}
    lm = spark.createDataFrame([("legitimate", 0), ("phishing", 1)], "label string, label_id long")
    K.save_label_map(lm, os.path.join(tmp_dir, "labels"))
    assert json.loads(K.read_document(spark, os.path.join(tmp_dir, "labels"))) == {"legitimate": 0, "phishing": 1}
    K.save_meta(spark, {"max_len": 256}, os.path.join(tmp_dir, "meta"))
    assert json.loads(K.read_document(spark, os.path.join(tmp_dir, "meta"))) == {"max_len": 256}
    report = {"n_rows": 3, "n_used_for_eval": 2, "labels": {0: "legitimate", 1: "phishing"}, "accuracy": 0.5,
              "per_class": [], "confusion_matrix": {"labels_order": ["legitimate", "phishing"],
                                                    "matrix": [[1, 0], [1, 0]]}, "examples_misclassified": []}
    K.save_report(spark, report, os.path.join(tmp_dir, "report"))
    back = json.loads(K.read_document(spark, os.path.join(tmp_dir, "report")))
    assert back["confusion_matrix"]["matrix"] == [[1, 0], [1, 0]] and back["labels"] == {"0": "legitimate",
                                                                                         "1": "phishing"}


def test_bucketed_mail_join_has_no_exchange(spark, tmp_dir):
    """Co-located join: documents and labels bucketed by doc_id join
    without shuffling either side, and give the same rows as ``mail``."""
    from pyspark.sql import functions as F

    from conftest import SF001
    from mailsift.sources import tables as tb

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = tb.bucket_mail_tables(spark, SF001, f"{tmp_dir}/bucketed", 8, prefix=f"t{abs(hash(tmp_dir)) % 10**6}")
        m = tb.mail_bucketed(spark, names)
        plan = m._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = sorted(m.select("row_id", "y", F.length("body").alias("n")).collect())
        want = sorted(tb.mail(spark, SF001).select("row_id", "y", F.length("body").alias("n")).collect())
        assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
