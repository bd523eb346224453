"""Label queries: LBL-1 ... LBL-8, PRJ-7, PRJ-8, SHP-9."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.operators import labels as L
from mailsift.plans.registry import register, sql_list
from mailsift.sources import tables as tb

def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A{P.WS}+|{P.WS}+\\z', '', 'g')"


def _string_rules_sql(x: str) -> str:
    s = f"lower({_strip_sql(x)})"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} IN {sql_list(P.PHISHING_WORDS)} THEN 'phishing' "
            f"WHEN {s} IN {sql_list(P.LEGIT_WORDS)} THEN 'legitimate' "
            f"WHEN {s} IN {sql_list(P.PHISHING_FLAGS)} THEN 'phishing' "
            f"WHEN {s} IN {sql_list(P.LEGIT_FLAGS)} THEN 'legitimate' ELSE {s} END")


_NUM_RULE_SQL = ("CASE WHEN label_num IS NULL THEN NULL WHEN abs(label_num) >= 1 THEN 'phishing' "
                 "ELSE 'legitimate' END")
DEFAULT_LABEL2ID = {v: k for k, v in P.DEFAULT_ID2LABEL.items()}


@register("lbl1_normalize_label", tb.with_views(
    f"SELECT row_id, {_string_rules_sql('label')} AS label_norm, {_NUM_RULE_SQL} AS label_num_norm "
    "FROM mail_raw_label", "mail_raw_label"))
def lbl1_normalize_label(spark, d):
    df = tb.mail_raw_label(spark, d)
    df = L.normalize_labels(df, "label", "label_norm")
    df = L.normalize_labels(df, "label_num", "label_num_norm")
    return df.select("row_id", "label_norm", "label_num_norm")


@register("lbl2_normalize_printed", tb.with_views(
    f"SELECT row_id, {_string_rules_sql('CAST(label_num AS VARCHAR)')} AS label_num_printed_norm, "
    f"{_string_rules_sql('label')} AS label_norm FROM mail_raw_label", "mail_raw_label"))
def lbl2_normalize_printed(spark, d):
    df = tb.mail_raw_label(spark, d)
    kind_num = L.label_kind(df, "label_num")
    kind_str = L.label_kind(df, "label")
    return df.select("row_id",
                     L.normalize_label_printed("label_num", kind_num).alias("label_num_printed_norm"),
                     L.normalize_label_printed("label", kind_str).alias("label_norm"))


def _ids_sql(x: str) -> str:
    s = _strip_sql(x)
    exact = " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEFAULT_LABEL2ID.items())
    lower = " ".join(f"WHEN '{k.lower()}' THEN {v}" for k, v in DEFAULT_LABEL2ID.items())
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(TRY_CAST({x} AS INTEGER), "
            f"CASE {s} {exact} END, CASE lower({s}) {lower} END) END")


@register("lbl3_label_to_id", tb.with_views(
    f"SELECT conv_id, turn, CAST({_ids_sql('label')} AS INTEGER) AS y_true FROM mail_subject", "mail_subject"))
def lbl3_label_to_id(spark, d):
    df = tb.mail_subject(spark, d)
    return L.label_ids(df, "label", DEFAULT_LABEL2ID).select("conv_id", "turn", "y_true")


_UNION_LABELS = ("all_labels", f"SELECT {_string_rules_sql('label')} AS label FROM mail_raw_label "
                 f"UNION ALL SELECT {_string_rules_sql('label')} AS label FROM mail_subject")
_MAP_SQL = ("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS label_id "
            "FROM (SELECT DISTINCT label FROM all_labels WHERE label IS NOT NULL)")


def _union_label_map(spark, d):
    train = L.normalize_labels(tb.mail_raw_label(spark, d), "label")
    test = L.normalize_labels(tb.mail_subject(spark, d), "label")
    return train, L.build_label_map(train, test)


@register("lbl4_label_map", tb.with_views(_MAP_SQL, "mail_raw_label", "mail_subject", extra=[_UNION_LABELS]))
def lbl4_label_map(spark, d):
    return _union_label_map(spark, d)[1]


@register("lbl5_encode_labels", tb.with_views(
    f"SELECT t.row_id, m.label_id FROM (SELECT row_id, {_string_rules_sql('label')} AS label FROM mail_raw_label) t "
    "JOIN label_map m ON t.label = m.label",
    "mail_raw_label", "mail_subject", extra=[_UNION_LABELS, ("label_map", _MAP_SQL)]))
def lbl5_encode_labels(spark, d):
    train, lm = _union_label_map(spark, d)
    return L.encode_labels(train.dropna(subset=["label"]), lm, "label").select("row_id", "label_id")


@register("lbl6_id_to_name", tb.with_views(
    "SELECT row_id, y_pred, CASE y_pred WHEN 0 THEN 'legitimate' WHEN 1 THEN 'phishing' END AS y_pred_name "
    "FROM pred", "pred"))
def lbl6_id_to_name(spark, d):
    return L.id_to_name(tb.pred(spark, d), "y_pred").select("row_id", "y_pred", "y_pred_name")


@register("lbl7_binary_literal", tb.with_views(
    "SELECT conv_id, turn, CASE WHEN label = 'phishing' THEN 1 ELSE 0 END AS y_bin FROM mail_subject",
    "mail_subject"))
def lbl7_binary_literal(spark, d):
    return tb.mail_subject(spark, d).select("conv_id", "turn", L.binary_label("label", "phishing").alias("y_bin"))


@register("lbl8_class_weights",
          "SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 9) AS weight "
          "FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def lbl8_class_weights(spark, d):
    w = L.class_weights(tb.load(spark, d, "embeddings"), "label")
    return w.withColumn("weight", F.round("weight", 9))


@register("prj7_valid_labels", tb.with_views(
    f"SELECT count(*) AS n_rows, count({_ids_sql('label')}) AS n_valid FROM mail_subject", "mail_subject"))
def prj7_valid_labels(spark, d):
    df = L.label_ids(tb.mail_subject(spark, d), "label", DEFAULT_LABEL2ID)
    return L.valid_label_counts(df, "y_true")


_KNOWN = sql_list(DEFAULT_LABEL2ID)


@register("prj8_known_labels", tb.with_views(
    f"SELECT row_id, label_norm FROM (SELECT row_id, {_string_rules_sql('label')} AS label_norm "
    f"FROM mail_raw_label WHERE label IS NOT NULL) WHERE label_norm IN {_KNOWN}", "mail_raw_label"))
def prj8_known_labels(spark, d):
    df = tb.mail_raw_label(spark, d).dropna(subset=["label"])
    df = df.select("row_id", L.normalize_label_printed("label", {"kind": "string"}).alias("label_norm"))
    lm = L.label_map_frame(spark, DEFAULT_LABEL2ID)
    return L.keep_known_labels(df, lm, "label_norm")


@register("prj8_unknown_label_count", tb.with_views(
    f"SELECT count(*) AS n_unknown FROM (SELECT {_string_rules_sql('CAST(label_num AS VARCHAR)')} AS l "
    f"FROM mail_raw_label) WHERE l NOT IN {_KNOWN}", "mail_raw_label"))
def prj8_unknown_label_count(spark, d):
    df = tb.mail_raw_label(spark, d)
    kind = L.label_kind(df, "label_num")
    df = df.select(L.normalize_label_printed("label_num", kind).alias("l"))
    return L.unknown_label_count(df, L.label_map_frame(spark, DEFAULT_LABEL2ID), "l")
