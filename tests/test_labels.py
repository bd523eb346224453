"""Labels (LBL-*): the hand-derived table of FIXTURES.md §3."""

from pyspark.sql import functions as F

from mailsift.operators import labels as L

LABEL2ID = {"legitimate": 0, "phishing": 1}


def _norm(spark, values, schema):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r.n for r in sorted(L.normalize_labels(df, "v", "n").collect(), key=lambda r: r.i)]


def test_lbl1_numeric_column(spark):
    assert _norm(spark, [1.0, 0.5, -1.0, 0.0, None], "double") == \
        ["phishing", "legitimate", "phishing", "legitimate", None]


def test_lbl1_numeric_text_column_is_numeric(spark):
    # A text column whose values all parse as numbers is numeric (CSV inference).
    assert _norm(spark, ["1", "0", "2"], "string") == ["phishing", "legitimate", "phishing"]


def test_lbl1_string_column(spark):
    got = _norm(spark, ["SPAM", " Ham ", "True", "Phishing", "Safe Email", "2", "1.0", "yes", "NO"], "string")
    assert got == ["phishing", "legitimate", "phishing", "phishing", "safe email", "2", "1.0", "phishing",
                   "legitimate"]


def test_lbl2_printed_float_column(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (-1.0,), (None,)], "v double")
    kind = L.label_kind(df, "v")
    got = [r[0] for r in df.select(L.normalize_label_printed("v", kind)).collect()]
    assert got == ["1.0", "0.5", "-1.0", None]


def test_lbl2_integer_column_prints_without_fraction(spark):
    df = spark.createDataFrame([(1,), (0,)], "v long")
    kind = L.label_kind(df, "v")
    kind["frac"] = False  # an integer column without nulls prints as 1 / 0
    got = [r[0] for r in df.select(L.normalize_label_printed("v", kind)).collect()]
    assert got == ["phishing", "legitimate"]


def test_lbl3_ids(spark):
    num = spark.createDataFrame([(1.0,), (0.5,), (-1.0,)], "v double")
    assert [r.y_true for r in L.label_ids(num, "v", LABEL2ID).collect()] == [1, 0, -1]
    s = spark.createDataFrame([("SPAM",), (" Ham ",), ("True",), ("Phishing",), ("Safe Email",), ("2",),
                               ("1.0",), (None,)], "v string")
    got = [r.y_true for r in L.label_ids(s, "v", LABEL2ID, {"kind": "string"}).collect()]
    assert got == [None, None, None, 1, None, 2, None, None]


def test_lbl4_lbl5_lbl6(spark):
    a = spark.createDataFrame([("phishing",), ("legitimate",)], "label string")
    b = spark.createDataFrame([("safe email",), ("phishing",)], "label string")
    lm = L.build_label_map(a, b)
    assert {r.label: r.label_id for r in lm.collect()} == {"legitimate": 0, "phishing": 1, "safe email": 2}
    enc = L.encode_labels(a, lm)
    assert sorted(r.label_id for r in enc.collect()) == [0, 1]
    named = L.id_to_name(spark.createDataFrame([(0,), (1,), (7,)], "y int"), "y")
    assert sorted((r.y, r.y_name) for r in named.collect()) == [(0, "legitimate"), (1, "phishing"), (7, None)]


def test_lbl5_unknown_label_raises(spark):
    lm = L.label_map_frame(spark, LABEL2ID)
    df = spark.createDataFrame([("spam",)], "label string")
    try:
        L.encode_labels(df, lm)
    except KeyError as e:
        assert "spam" in str(e)
    else:
        raise AssertionError("expected KeyError")


def test_lbl7_lbl8(spark):
    df = spark.createDataFrame([("Phishing Email",), ("Safe Email",), (None,)], "t string")
    assert [r[0] for r in df.select(L.binary_label("t", "Phishing Email")).collect()] == [1, 0, 0]
    w = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    weights = {r.y: r.weight for r in L.class_weights(w, "y").collect()}
    assert weights == {0: 4 / (2 * 3), 1: 4 / (2 * 1)}


def test_prj8_semi_anti(spark):
    lm = L.label_map_frame(spark, LABEL2ID)
    df = spark.createDataFrame([("phishing",), ("1.0",), ("legitimate",)], "label string")
    assert L.keep_known_labels(df, lm).count() == 2
    assert L.unknown_label_count(df, lm).first()[0] == 1
    assert F is not None


def test_numbers_with_type_suffixes_are_text_and_large_numbers_are_no_class(spark):
    from mailsift.operators import labels as L

    mixed = spark.createDataFrame([("1d",), ("2f",)], "label string")
    assert L.label_kind(mixed, "label")["kind"] == "string"
    large = spark.createDataFrame([("99999999999",), ("1",), ("-3.7",)], "label string")
    assert sorted((r.y_true is None, r.y_true or 0) for r in L.label_ids(large, "label", {"a": 0}).collect()) == [(False, -3), (False, 1), (True, 0)]
