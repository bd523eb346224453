"""Row-set shaping (SHP-*): the original split test, ratios, determinism
across partition counts, disjoint cover, balance, first-wins dedup."""

import os

import pytest
from pyspark.sql import functions as F

from mailsift.operators import shape as S


def _frame(spark, labels, parts=None):
    df = spark.createDataFrame([(i, "a", l) for i, l in enumerate(labels)], "row_id long, text string, label int")
    return df.repartition(parts) if parts else df


def _sizes(df):
    return {r.split: r.n for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_split_80_10_10(spark):
    """The reference's only test: 100 rows, 50/50 -> 80 / 10 / 10."""
    df = S.stratified_split(_frame(spark, [0] * 50 + [1] * 50), "label", "row_id", 0.2, 0.5, seed=1)
    assert _sizes(df) == {"train": 80, "val": 10, "test": 10}


def test_split_keeps_class_ratio(spark):
    df = S.stratified_split(_frame(spark, [0] * 900 + [1] * 100), "label", "row_id", 0.2, 0.5)
    by = {(r.split, r.label): r.n for r in df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    for part, total in (("train", 800), ("val", 100), ("test", 100)):
        assert abs(by[(part, 1)] - total * 0.1) <= 1
        assert by[(part, 0)] + by[(part, 1)] == total


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_split_same_membership_for_any_partitioning(spark, parts):
    labels = [i % 3 for i in range(500)]
    ref = {r.row_id: r.split for r in S.stratified_split(_frame(spark, labels), "label", "row_id").collect()}
    got = {r.row_id: r.split for r in S.stratified_split(_frame(spark, labels, parts), "label", "row_id").collect()}
    assert got == ref
    assert len(got) == 500


def test_split_70_10_20_and_unstratified_test(spark):
    df = S.stratified_split(_frame(spark, [0] * 70 + [1] * 30), "label", "row_id", 0.3, 2 / 3)
    assert _sizes(df) == {"train": 70, "val": 10, "test": 20}
    df2 = S.split_test_then_stratified_val(_frame(spark, [0] * 70 + [1] * 30), "label", "row_id")
    s = _sizes(df2)
    assert s["test"] == 20 and s["val"] == 10 and s["train"] == 70
    assert df2.select("row_id").distinct().count() == 100


def test_seeded_rank_matches_exact_window(spark):
    from pyspark.sql import Window
    labels = [i % 2 for i in range(3000)]
    df = _frame(spark, labels, 16)
    cuts = {0: [100, 700], 1: [5, 1499]}
    seg = S.seeded_segments(df, "label", "row_id", 42, cuts, "seg")
    w = Window.partitionBy("label").orderBy(S.seed_hash(42, "row_id"), "row_id")
    exact = df.withColumn("rk", F.row_number().over(w) - 1)
    exp = {r.row_id: sum(c <= r.rk for c in cuts[r.label]) for r in exact.collect()}
    assert {r.row_id: r.seg for r in seg.collect()} == exp


@pytest.mark.parametrize("digits", [1, 2])
def test_seeded_rank_all_levels(spark, monkeypatch, digits):
    """Few buckets per level, so rows are decided at levels 1, 2 and 3."""
    from pyspark.sql import Window
    monkeypatch.setattr(S, "DIGITS", digits)
    labels = [0 if i % 3 else 1 for i in range(3000)]
    df = _frame(spark, labels, 8)
    cuts = {0: [0, 333, 1000, 1999], 1: [1, 500, 999]}
    seg = S.seeded_segments(df, "label", "row_id", 7, cuts, "seg")
    w = Window.partitionBy("label").orderBy(S.seed_hash(7, "row_id"), "row_id")
    exact = df.withColumn("rk", F.row_number().over(w) - 1)
    exp = {r.row_id: sum(c <= r.rk for c in cuts[r.label]) for r in exact.collect()}
    got = {r.row_id: r.seg for r in seg.collect()}
    assert got == exp


def test_balance_equal_counts(spark):
    df = S.balance_classes(_frame(spark, [0] * 30 + [1] * 7 + [2] * 5), "label", "row_id", (0, 1))
    counts = {r.label: r.n for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {0: 7, 1: 7}
    same = S.balance_classes(_frame(spark, [0] * 5 + [1] * 5), "label", "row_id", (0, 1))
    assert same.count() == 10


def test_dedup_keeps_first_in_order(spark):
    df = spark.createDataFrame([(3, "x", 1), (1, "x", 0), (2, "y", 1), (5, "y", 0)], "ord long, text string, label int")
    out = {r.text: (r.ord, r.label) for r in S.drop_duplicates_first(df, ["text"], ["ord"]).collect()}
    assert out == {"x": (1, 0), "y": (2, 1)}


def _shares(spark, counts, n_draws, kind="int"):
    df = spark.createDataFrame(list(counts.items()), f"label {kind}, n long")
    return {r.label: r.share for r in S.largest_remainder(df, sum(counts.values()), n_draws).collect()}


def test_largest_remainder(spark):
    assert _shares(spark, {0: 50, 1: 50}, 80) == {0: 40, 1: 40}
    assert _shares(spark, {0: 2, 1: 1}, 2) == {0: 1, 1: 1}
    assert sum(_shares(spark, {0: 7, 1: 5, 2: 3}, 9).values()) == 9
    assert _shares(spark, {"b": 1, "a": 1, None: 1}, 2, "string") == {"a": 1, "b": 1, None: 0}
    assert _shares(spark, {}, 0) == {}


def test_split_of_many_classes(spark):
    """As many classes as rows / 2, none of them collected: sizes as for one class."""
    df = spark.range(6000).select(F.col("id").alias("row_id"), (F.col("id") % 3000).alias("label"))
    out = S.stratified_split(df, "label", "row_id", 0.2, 0.5)
    assert _sizes(out) == {"train": 4800, "val": 600, "test": 600}
    per = out.filter("split = 'train'").groupBy("label").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(per) == (1, 2)


def _reads(df, folder):
    return df._jdf.queryExecution().executedPlan().toString().count(folder)


def test_split_reads_the_rows_once_more(spark, tmp_dir):
    """Keys and classes are read once and written; the result's own plan reads the rows once."""
    _frame(spark, [i % 3 for i in range(300)]).write.parquet(f"{tmp_dir}/rows_in")
    df = spark.read.parquet(f"{tmp_dir}/rows_in")
    for out in (S.stratified_split(df, "label", "row_id"), S.split_test_then_stratified_val(df, "label", "row_id"),
                S.balance_classes(df, "label", "row_id")):
        assert _reads(out, "/rows_in") == 1
        assert out.count() > 0


def test_words_only_in_and_lookup(spark):
    words = spark.createDataFrame([(1, "a"), (1, "b"), (0, "b"), (1, "c")], "y int, word string")
    assert sorted(r.word for r in S.words_only_in(words, "y", 1).collect()) == ["a", "c"]
    dim = spark.createDataFrame([("a", 5)], "k string, v long")
    out = S.lookup_with_default(words, "word", dim, "k", "v", 0)
    assert sorted(r.v for r in out.collect()) == [0, 0, 0, 5]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_fresh_index_contiguous_in_order(spark, tmp_dir, parts):
    """SHP-12 across partition counts (coalescing off, so the per-partition
    offsets are exercised): equals a global row_number, 0..n-1."""
    from pyspark.sql import Window

    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        a = spark.range(0, 3000).select((F.col("id") % 7).alias("f"), (F.col("id") * 7919 % 3001).alias("k"))
        b = spark.range(0, 500).select(F.lit(9).alias("f"), F.col("id").alias("k"))
        df = a.unionByName(b).repartition(5)
        got = {(r.f, r.k): r.row_idx for r in S.fresh_index(df, ["f", "k"], f"{tmp_dir}/idx{parts}").collect()}
        want = {(r.f, r.k): r.i for r in
                df.select("f", "k", (F.row_number().over(Window.orderBy("f", "k")) - 1).alias("i")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and sorted(got.values()) == list(range(3500))


def test_split_folders_prune(spark, tmp_dir):
    """SHP-13: a split filter on the written table reads one folder."""
    df = S.stratified_split(_frame(spark, [0] * 50 + [1] * 50), "label", "row_id", 0.2, 0.5, seed=1)
    S.write_splits(df, f"{tmp_dir}/splits")
    back = spark.read.parquet(f"{tmp_dir}/splits").filter(F.col("split") == "test")
    assert back.count() == 10
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()


def test_split_keeps_null_labels_as_a_class(spark):
    rows = [(i, "a" if i % 2 else None) for i in range(101)]
    out = S.stratified_split(spark.createDataFrame(rows, "k long, label string"), "label", "k").collect()
    assert sorted(r.k for r in out) == list(range(101))
    assert {r.split for r in out if r.label is None} == {"train", "val", "test"}


def test_dedup_does_not_group_by_the_text(spark):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), (None, 3, "c"), (None, 4, "d"), ("", 5, "e")], "text string, ord long, label string")
    out = S.drop_duplicates_first(df, ["text"], ["ord"])
    assert sorted(map(str, out.collect())) == sorted(map(str, df.where("ord IN (1, 3, 5)").collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_stored_split_is_drawn_once_and_follows_the_rows(spark, monkeypatch):
    drawn = []
    table = S._split_table
    monkeypatch.setattr(S, "_split_table", lambda *a: drawn.append(1) or table(*a))
    df = _frame(spark, [0] * 300 + [1] * 100)
    exp = sorted(map(tuple, S.stratified_split(df, "label", "row_id", 0.2, 0.5, 7).select("row_id", "split").collect()))
    drawn.clear()
    for again in (df, df.repartition(7), df.withColumn("more", F.rand())):
        got = S.stored_split(again, "label", "row_id", 0.2, 0.5, 7)
        assert set(again.columns) | {"split"} == set(got.columns)
        assert sorted(map(tuple, got.select("row_id", "split").collect())) == exp
    assert len(drawn) == 1
    changed = df.withColumn("label", F.expr("IF(row_id = 5, 1 - label, label)"))
    for other in (S.stored_split(changed, "label", "row_id", 0.2, 0.5, 7), S.stored_split(df, "label", "row_id", 0.2, 0.5, 8),
                  S.stored_split(df.limit(0), "label", "row_id", 0.2, 0.5, 7)):
        assert other.count() in (0, 400)
    assert len(drawn) == 4


def test_handoff_scope_deletes_what_it_wrote(spark):
    from mailsift import session

    def made_by(df):
        return df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]

    outer = session.handoff(spark.range(3), "outer")
    with pytest.raises(KeyError), session.handoff_scope(spark) as made:
        inner, kept = session.handoff(spark.range(4), "inner"), session.handoff(spark.range(5), "kept")
        made.pop()
        with session.handoff_scope(spark):
            nested = session.handoff(spark.range(6), "nested")
            gone = [made_by(inner), made_by(nested)]
        raise KeyError
    assert outer.count() == 3 and kept.count() == 5
    assert not any(os.path.exists(p) for p in gone) and os.path.exists(made_by(kept))
