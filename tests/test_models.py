"""Model queries (MOD-*, UDF-3/4): invariants, and the external scorer
against a brute-force numpy nearest-centroid computation."""

import shutil

import numpy as np
import pyarrow.parquet as pq
import pytest

from conftest import SF001
from mailsift.operators import shape as S
from mailsift.plans import queries_models as QM
from mailsift.plans.queries_shape import SEED
from mailsift.plans.registry import queries

Q = queries()


@pytest.mark.parametrize("name", ["mod1_logreg_bow", "mod2_decision_tree_bow", "mod3_embedding_mlp"])
def test_scores_each_heldout_row_once(spark, name):
    out = Q[name](spark, SF001).collect()
    test_ids = {r.row_id for r in QM._split(spark, SF001)[1].select("row_id").collect()}
    ids = [r.row_id for r in out]
    assert len(ids) == len(set(ids)) and set(ids) == test_ids
    assert all(r.y_pred in (0, 1) and 0.5 <= r.conf <= 1.0 for r in out)


def test_embedding_model_learns_from_many_partitions(spark):
    """Two vocabularies, one per class: the embeddings are trained on several
    parts of the rows and the held-out rows are told apart."""
    from pyspark.sql import functions as F

    from mailsift.operators import models as M

    rows = spark.range(0, 240, numPartitions=6).select(
        "id", (F.col("id") % 2).cast("double").alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((i * 7 + F.col("id") * 5) % 10 + 2 + 10 * (F.col("id") % 2)).cast("int")).alias("ids"))
    rows = rows.withColumn("words", M.id_words(F.concat("ids", F.array(F.lit(0)))))
    model = M.embedding_mlp("words", "label", 2, emb_dim=8, hidden=8, partitions=6).fit(rows.filter("id < 200"))
    assert model.stages[0].getNumPartitions() == 6 and model.stages[0].getVectors().count() == 20
    out = M.score(model, rows.filter("id >= 200")).select("label", "y_pred").collect()
    assert len(out) == 40 and sum(r.label == r.y_pred for r in out) >= 36


class Cut(Exception):
    pass


def test_epochs_go_on_after_a_cut_and_keep_the_best(spark, tmp_dir):
    """A run cut in its second epoch goes on to the same weights, rows and choice as
    one that was not; the choice is the latest arg-max of the metrics table."""
    from pyspark.sql import functions as F

    from mailsift.operators import evaluate as E
    from mailsift.operators import models as M

    rows = spark.range(0, 120, numPartitions=2).select(
        "id", (F.col("id") % 2).cast("double").alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i * 7 + F.col("id") * 5) % 10 + 6 * (F.col("id") % 2)).cast("string")).alias("tokens"))
    train, val = rows.filter("id < 90"), rows.filter("id >= 90")

    def accuracy(scored):
        return E.accuracy(scored, "label", "y_pred").first()[0]

    calls = []

    def cut_second(scored):
        calls.append(1)
        if len(calls) == 2:
            raise Cut
        return accuracy(scored)

    kind = {"emb_dim": 4, "hidden": 4, "steps": 2, "passes": 1}
    one, two = f"{tmp_dir}/one", f"{tmp_dir}/two"
    whole, of_whole = M.fit_epochs(train, val, one, 3, accuracy, **kind)
    # Both runs on the same vectors: learning these depends on the order of rows.
    for part in ("run", "vectors", "train"):
        shutil.copytree(f"{one}/{part}", f"{two}/{part}")
    with pytest.raises(Cut):
        M.fit_epochs(train, val, two, 3, cut_second, **kind)
    again, of_again = M.fit_epochs(train, val, two, 3, cut_second, **kind)
    assert len(calls) == 4  # the first epoch is not run again
    rows_whole, rows_again = (sorted((r.epoch, r.metric) for r in t.collect()) for t in (of_whole, of_again))
    assert rows_whole == rows_again and [e for e, _ in rows_whole] == [1, 2, 3]
    assert np.allclose(whole.stages[1].weights.toArray(), again.stages[1].weights.toArray(), rtol=1e-3)
    of_whole.createOrReplaceTempView("epoch_metrics")
    best = spark.sql("SELECT max_by(epoch, struct(metric, epoch)) FROM epoch_metrics").first()[0]
    kept = M.MultilayerPerceptronClassificationModel.load(f"{one}/epochs/{best}")
    assert np.allclose(kept.weights.toArray(), whole.stages[1].weights.toArray())
    with pytest.raises(ValueError, match="other settings"):
        M.fit_epochs(train, val, two, 3, accuracy, **(kind | {"steps": 3}))


def test_two_kinds_of_model_by_path(spark, tmp_dir):
    from mailsift.operators import scorers as SC

    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 4.0]), (3, [-1.0, 0.5])], "id int, v array<double>")
    SC.save_scorer(spark, f"{tmp_dir}/a", SC.CENTROIDS, SC.centroid_payload([[0.0, 0.0], [3.0, 4.0]]), ["v"], [[2]])
    SC.save_scorer(spark, f"{tmp_dir}/b", SC.LINEAR, SC.linear_payload([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [0.0, 0.5, -1.0]), ["v"], [[2]])
    got = {r.id: r for r in rows.select("id", "v", SC.scorer_at(spark, f"{tmp_dir}/a").alias("a"), SC.scorer_at(spark, f"{tmp_dir}/b").alias("b")).collect()}
    for r in got.values():
        x = np.array(r.v)
        assert np.allclose(r.a, [np.linalg.norm(x), np.linalg.norm(x - [3.0, 4.0])])
        z = np.exp(np.array([x[0], x[1] + 0.5, x.sum() - 1.0]))
        assert np.allclose(r.b, z / z.sum())
    with pytest.raises(FileNotFoundError):
        SC.scorer_at(spark, f"{tmp_dir}/none")
    # A payload that is not the manifest's is refused in the workers.
    SC.save_scorer(spark, f"{tmp_dir}/c", SC.CENTROIDS, SC.centroid_payload([[9.0, 9.0]]), ["v"], [[2]])
    SC._write(spark, f"{tmp_dir}/c/payload-{SC.read_manifest(spark, f'{tmp_dir}/c')['sha256']}", b"[[1.0, 1.0]]")
    with pytest.raises(Exception, match="differs from its manifest"):
        rows.select(SC.scorer_at(spark, f"{tmp_dir}/c").alias("s")).collect()


def test_scorer_by_path_equals_scorer_by_function(spark):
    a, b = ({r.row_id: (r.y_pred, r.dist) for r in Q[name](spark, SF001).collect()} for name in ("udf4_scorer_by_path", "udf4_external_scorer"))
    assert a == b and a


def test_external_scorer_equals_numpy(spark):
    got = {r.row_id: (r.y_pred, r.dist) for r in Q["udf4_external_scorer"](spark, SF001).collect()}
    t = pq.read_table(f"{SF001}/embeddings.parquet").to_pandas()
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    split = {r.row_id: r.split for r in
             S.stratified_split(emb, "label", "row_id", 0.2, 0.5, SEED).select("row_id", "split").collect()}
    t["split"] = t["vec_id"].map(split)
    tr = t[t.split == "train"]
    labels = sorted(tr.label.unique())
    cents = np.stack([np.mean(np.stack(tr[tr.label == k].embedding.to_list()).astype(np.float64), axis=0)
                      for k in labels])
    te = t[t.split == "test"]
    x = np.stack(te.embedding.to_list()).astype(np.float64)
    dist = np.sqrt(((x[:, None, :] - cents[None]) ** 2).sum(axis=2))
    want = {int(v): (int(labels[i]), round(float(d), 6))
            for v, i, d in zip(te.vec_id, dist.argmin(axis=1), dist.min(axis=1))}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_metric_callback_rows(spark):
    rows = {r.metric: r.value for r in Q["udf3_metric_callback"](spark, SF001).collect()}
    assert set(rows) == {"accuracy", "precision", "recall", "f1"}
    assert all(0.0 <= v <= 1.0 for v in rows.values())


def test_for_fit_keeps_rows_and_sizes_partitions_by_bytes(spark):
    from mailsift.operators import models as M

    for n in (300, 100_000):
        made = M.for_fit(spark.range(0, n, numPartitions=16).selectExpr("id", "id % 7 AS y"))
        assert made.columns == ["id", "y"] and made.count() == n
        assert made.agg({"id": "sum"}).first()[0] == n * (n - 1) // 2


def test_batch_map_hands_on_small_frames(spark):
    """However many rows an Arrow batch has, a user's function gets at most
    FRAME_BYTES of them (or one row), every row once and in order."""
    import pandas as pd

    from mailsift.functions import hooks as H
    from mailsift.plans.queries_udf import tokenize_batch

    sizes = [5_000_000, 10, 12_000_000, 3_000_000, 4_000_000, 2_000_000, 0]
    batch = pd.DataFrame({"id": range(8), "text": ["x" * n for n in sizes] + [None]})
    frames = list(H._frames(batch))
    assert [list(f["id"]) for f in frames] == [[0, 1], [2], [3, 4], [5, 6, 7]]
    assert all(list(f.index) == list(range(len(f))) for f in frames)
    assert [len(f) for f in H._frames(batch.iloc[:0])] == [0]
    rows = spark.createDataFrame([(i, "a b a" * 400_000) for i in range(12)], "id long, text string").coalesce(1)
    got = H.batch_map(rows, lambda b: pd.DataFrame({"id": b["id"], "n": len(b)}), "id long, n long").collect()
    assert sorted(r.id for r in got) == list(range(12)) and max(r.n for r in got) <= H.FRAME_BYTES // 2_000_000
    found = tokenize_batch(pd.DataFrame({"doc_id": [1, 2, 3], "text": ["A b, a_1 É-b", None, ""]}))
    assert found.values.tolist() == [[1, 5, 4], [2, 0, 0], [3, 0, 0]]
