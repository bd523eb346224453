"""Features (FEA-*), evaluation (EVL-*) and logs (LOG-*) on small inputs
with hand-checked or brute-force expectations."""

import math
import random

import pytest

from mailsift.operators import evaluate as E
from mailsift.operators import features as FE
from mailsift.operators import logs as G


@pytest.fixture()
def corpus(spark):
    rows = [(1, ["b", "a", "b", "c"]), (2, ["a", "b"]), (3, []), (4, ["d", "a", "b", "z", "b"])]
    return spark.createDataFrame(rows, "row_id long, tokens array<string>")


def test_vocab_order_and_specials(spark, corpus):
    v = {r.token: (r.freq, r.id) for r in FE.build_vocab(corpus, "tokens", min_freq=2).collect()}
    assert v == {"<pad>": (0, 0), "<unk>": (0, 1), "b": (5, 2), "a": (3, 3)}
    capped = FE.build_vocab(corpus, "tokens", min_freq=1, max_size=4).collect()
    assert sorted(r.token for r in capped) == ["<pad>", "<unk>", "a", "b"]


def test_encode_pad_truncate_unk_and_decode(spark, corpus):
    vocab = FE.build_vocab(corpus, "tokens", min_freq=2)
    enc = {r.row_id: r.ids for r in FE.encode_ids(corpus, "row_id", "tokens", vocab, max_len=4).collect()}
    assert enc == {1: [2, 3, 2, 1], 2: [3, 2, 0, 0], 3: [0, 0, 0, 0], 4: [1, 3, 2, 1]}
    n_vocab = vocab.count()
    assert all(0 <= i < n_vocab for ids in enc.values() for i in ids)
    df = spark.createDataFrame(list(enc.items()), "row_id long, ids array<int>")
    lengths = {r.row_id: r.n for r in df.select("row_id", FE.real_length("ids").alias("n")).collect()}
    assert lengths == {1: 4, 2: 2, 3: 1, 4: 4}
    dec = {r.row_id: r.text for r in FE.decode_ids(df, "row_id", "ids", vocab).collect()}
    assert dec == {1: "b a b <unk>", 2: "a b", 3: "", 4: "<unk> a b <unk>"}


def test_encode_is_one_plan_and_refuses_repeated_keys(spark, corpus):
    """A shuffled join gives the broadcast join's ids, and a key that comes
    twice (with tokens, without, or one of each) raises."""
    vocab = FE.build_vocab(corpus, "tokens", min_freq=1)
    a = {r.row_id: r.ids for r in FE.encode_ids(corpus, "row_id", "tokens", vocab, 3).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        b = {r.row_id: r.ids for r in FE.encode_ids(corpus, "row_id", "tokens", vocab, 3).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert a == b and len(a) == 4
    for again in ([(1, ["a"])], [(3, [])], [(3, ["a"])], [(2, [])]):
        rows = corpus.unionByName(spark.createDataFrame(again, corpus.schema))
        with pytest.raises(Exception, match="not unique"):
            FE.encode_ids(rows, "row_id", "tokens", vocab, 3).collect()


def test_attention_mask(spark):
    df = spark.createDataFrame([([5, 1, 0, 0],), ([0, 0, 0, 0],)], "ids array<int>")
    assert [r.m for r in df.select(FE.attention_mask("ids").alias("m")).collect()] == [[1, 1, 0, 0], [0, 0, 0, 0]]


def test_bag_of_words_train_vocabulary_only(spark):
    train = spark.createDataFrame([(1, "Hello hello world"), (2, "the x word")], "row_id long, text string")
    test = spark.createDataFrame([(9, "hello unseen world world the")], "row_id long, text string")
    got = {(r.term, r["count"]) for r in FE.bag_of_words(train, test, "row_id", "text").collect()}
    assert got == {("hello", 1), ("world", 2)}


def test_truncate_pad_and_mean_pool(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y", "z"]), (2, "a", ["x"]), (3, "b", ["y"])],
                               "row_id long, split string, tokens array<string>")
    out = {r.row_id: r.padded for r in FE.truncate_pad(df, "tokens", "split", 2).collect()}
    assert out == {1: ["x", "y"], 2: ["x", "<pad>"], 3: ["y"]}
    vec = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0])], "g int, v array<double>")
    assert {r.g: r.mean for r in FE.mean_vectors(vec, "g", "v").collect()} == {0: [2.0, 3.0], 1: [5.0, 5.0]}
    ids = spark.createDataFrame([(7, [2, 3, 0, 0]), (8, [0, 0]), (9, [])], "row_id long, ids array<int>")
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "id int, vector array<double>")
    pooled = {r.row_id: r.pooled for r in FE.masked_mean_pool(ids, "row_id", "ids", vectors).collect()}
    assert pooled == {7: [0.5, 0.5], 8: [0.0, 0.0], 9: [0.0, 0.0]}


def test_per_class_zero_division_and_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "y int, y_pred int")
    pc = {r.class_id: r for r in E.per_class(df, [0, 1, 2]).collect()}
    assert pc[0].precision == 0.5 and pc[0].recall == 1.0 and pc[0].f1 == pytest.approx(2 / 3)
    assert (pc[1].precision, pc[1].recall, pc[1].f1, pc[1].support) == (0.0, 0.0, 0.0, 2)
    assert pc[2].support == 0
    cm = {(r.y_true, r.y_pred): r.n for r in E.confusion_matrix(df, [0, 1]).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 2, (1, 1): 0}
    rep = {r.row: r for r in E.classification_report(df, [0, 1]).collect()}
    assert rep["accuracy"].f1 == 0.5 and rep["macro avg"].precision == 0.25
    rows = {r.metric: r.value for r in E.metric_rows(df, [0, 1], average="binary").collect()}
    assert rows == {"accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_softmax_argmax_first_max(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0],)], "logits array<double>")
    out = E.with_predictions(df, "logits").collect()
    assert [r.y_pred for r in out] == [1, 0]
    z = math.exp(1) + 2 * math.exp(3)
    assert out[0].probs[0] == pytest.approx(math.exp(1) / z)
    assert out[1].conf == pytest.approx(0.5)


def test_threshold_sweep_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0.0, 0.29, 0.5, 1.0, rnd.random()]), rnd.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "score double, y int")
    got = {r.t: (r.n_flagged, r.tp) for r in E.threshold_sweep(df).collect()}
    for t in range(101):
        flagged = [y for s, y in rows if s >= t / 100]
        assert got[t] == (len(flagged), sum(flagged)), t


def test_carry_forward_across_blocks(spark):
    rnd = random.Random(9)
    rows = [(i, None if rnd.random() < 0.6 else float(i) / 10, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "step long, epoch double, loss double")
    # 300 rows in blocks of 7 are three levels of summaries, in blocks of 3 five.
    for block in (3, 7, 1000):
        got = {r.step: r.ep for r in G.carry_forward(df, "epoch", "step", "ep", block=block).collect()}
        last = None
        for step, ep, _ in rows:
            last = ep if ep is not None else last
            assert got[step] == last, (block, step)


def test_carry_forward_gaps_negative_and_null_order(spark):
    steps = [-40, -39, -7, -1, 0, 3, 50, 51, 900, 10**12]
    rows = [(s, None if i in (0, 2, 5, 8) else float(i), "x") for i, s in enumerate(steps)] + [(None, 5.0, "y")]
    df = spark.createDataFrame(rows, "step long, epoch double, _blk0 string")
    out = G.carry_forward(df.withColumnRenamed("_blk0", "other"), "epoch", "step", "ep", block=4).collect()
    got = {r.step: r.ep for r in out}
    assert len(out) == len(rows) and got.pop(None) is None
    assert [got[s] for s in steps] == [None, 1.0, 1.0, 3.0, 4.0, 4.0, 6.0, 7.0, 7.0, 9.0]
    assert G.carry_forward(df.limit(0), "epoch", "step", "ep", block=4).collect() == []


def test_misclassified_positions(spark):
    rows = [(i, i % 3, 0 if i % 4 else 1, 0.9, f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, y_true int, y_pred int, conf double, text string").repartition(5)
    got = E.misclassified(df, ["ord"], k=10).collect()
    exp = [i for i, (_, y, p, _, _) in enumerate(rows) if y != p][:10]
    assert [e["index_in_valid"] for e in got] == exp
    assert got[0]["preview"] == f"t{exp[0]}"


def test_evaluation_frame_against_plain_counts(spark):
    """Three classes, an id no label names, long texts, a composite order."""
    names = {0: "a", 1: "b", 2: "c"}
    rows = [(i // 7, i % 7, i % 3, (i * i) % 4, (i % 10) / 9, "x" * (290 + i)) for i in range(50)]
    df = spark.createDataFrame([(*r[:3], float(r[3]), *r[4:]) for r in rows],
                               "k int, t int, y_true int, y_pred double, conf double, text string")
    rep = E.evaluation_report(df.repartition(4), df.union(df), ("k", "t"), id2label=names)
    assert (rep["n_rows"], rep["n_used_for_eval"], rep["labels"]) == (100, 50, names)
    assert rep["accuracy"] == round(sum(r[2] == r[3] for r in rows) / 50, 4)
    assert rep["confusion_matrix"] == {"labels_order": ["a", "b", "c"], "matrix": [
        [sum(r[2] == a and r[3] == b for r in rows) for b in names] for a in names]}
    for c, got in zip(names, rep["per_class"]):
        tp, sup, pred = (sum(f(r) for r in rows) for f in (lambda r: r[2] == r[3] == c, lambda r: r[2] == c, lambda r: r[3] == c))
        exp = (c, names[c], round(tp / pred, 4) if pred else 0, round(tp / sup, 4), round(2 * tp / (sup + pred), 4), sup)
        assert tuple(got.values()) == exp
    wrong = [(i, r) for i, r in enumerate(rows) if r[2] != r[3]][:10]
    assert [tuple(e.values()) for e in rep["examples_misclassified"]] == [
        (i, names[r[2]], names.get(r[3]), round(r[4], 4), r[5][:300]) for i, r in wrong]


def test_evaluation_frame_without_errors_or_rows(spark):
    schema = "row_id long, y_true int, y_pred int, conf double, text string"
    right = spark.createDataFrame([(1, 1, 1, 0.5, None), (2, 0, 0, None, "")], schema)
    rep = E.evaluation_report(right)
    assert (rep["n_rows"], rep["accuracy"], rep["examples_misclassified"]) == (2, 1.0, [])
    none = E.evaluation_frame(right.limit(0), right).first()
    assert (none.n_rows, none.n_used_for_eval, none.accuracy, none.examples_misclassified) == (2, 0, 0.0, [])
    with pytest.raises(ValueError, match="No valid labels"):
        E.evaluation_report(right.limit(0))

