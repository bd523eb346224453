"""Row-set shaping queries: SHP-1 ... SHP-13, SRC-4/5."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailsift.functions import text as X
from mailsift.operators import shape as S
from mailsift.plans.queries_profile import STOP_SQL
from mailsift.plans.registry import register
from mailsift.session import shared_scratch
from mailsift.sources import csv as C
from mailsift.sources import tables as tb

SEED = 42


def _rank_sql(src: str, by: str | None, seed: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (f"SELECT s.*, row_number() OVER ({part}ORDER BY md5('{seed}|' || CAST(row_id AS VARCHAR)), row_id) - 1 "
            f"AS rk FROM {src} s")


def _lr_sql(counts: str, n_draw: str, total: str, name: str) -> str:
    """Largest-remainder allocation in SQL (``counts`` has g, n_c)."""
    return f"""(SELECT g, CAST(base + CASE WHEN row_number() OVER (ORDER BY frac DESC, g) <= need THEN 1 ELSE 0 END
                     AS BIGINT) AS {name}
               FROM (SELECT g, floor(cont) AS base, cont - floor(cont) AS frac,
                            {n_draw} - sum(floor(cont)) OVER () AS need
                     FROM (SELECT g, CAST(n_c AS DOUBLE) / ({total}) * ({n_draw}) AS cont FROM {counts})))"""


def split_ctes(hold: float, toh: str) -> list[tuple[str, str]]:
    """CTEs computing the stratified split of ``mail``; the last one,
    ``splits``, holds (row_id, y, split)."""
    cls = "SELECT y AS g, count(*) AS n_c FROM mail GROUP BY y"
    tot = f"SELECT sum(n_c) AS n, CAST(ceil(CAST({hold} AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_hold FROM cls"
    tr = _lr_sql("cls", "(SELECT n - n_hold FROM tot)", "(SELECT n FROM tot)", "n_train")
    hold_cls = "SELECT c.g, c.n_c - t.n_train AS n_c FROM cls c JOIN tr t ON c.g = t.g"
    n_test = f"CAST(ceil(CAST({toh} AS DOUBLE) * n_hold) AS BIGINT)"
    va = _lr_sql("hold_cls", f"(SELECT n_hold - {n_test} FROM tot)", "(SELECT n_hold FROM tot)", "n_val")
    q = "SELECT tr.g, n_train, n_val FROM tr JOIN va ON tr.g = va.g"
    splits = f"""
SELECT row_id, y, CASE WHEN rk < n_train THEN 'train' WHEN rk < n_train + n_val THEN 'val' ELSE 'test' END AS split
FROM ({_rank_sql('mail', 'y', SEED)}) r JOIN q ON r.y = q.g"""
    return [("cls", cls), ("tot", tot), ("tr", tr), ("hold_cls", hold_cls), ("va", va), ("q", q), ("splits", splits)]


def _split_sql(hold: float, toh: str) -> str:
    return tb.with_views("SELECT row_id, y, split FROM splits", "mail", extra=split_ctes(hold, toh))


@register("src4_union_by_name", tb.with_views(
    "SELECT doc_id, NULL::BIGINT AS item_id, text, lang, 0 AS _file_ord FROM documents "
    "UNION ALL SELECT NULL::BIGINT, item_id, text, NULL::VARCHAR, 1 FROM benchmark"))
def src4_union_by_name(spark, d):
    """Both tables written as CSV folders and read by SRC-4: column union by name, files in order."""
    folder = shared_scratch(spark, f"queries/src4-{uuid.uuid4().hex}")
    C.write_csv(tb.load(spark, d, "documents").select("doc_id", "text", "lang"), f"{folder}/documents", C.UTF8)
    C.write_csv(tb.load(spark, d, "benchmark").select("item_id", "text"), f"{folder}/benchmark", C.UTF8)
    rows = C.read_csv_files(spark, [f"{folder}/documents", f"{folder}/benchmark"], C.UTF8)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("item_id").cast("long").alias("item_id"), "text", "lang", "_file_ord")


@register("src5_dropna_any", tb.with_views(
    "SELECT conv_id, turn, subject, body, label FROM mail_subject "
    "WHERE subject IS NOT NULL AND body IS NOT NULL AND label IS NOT NULL", "mail_subject"))
def src5_dropna_any(spark, d):
    """The mail table written as CSV and read by SRC-5."""
    path = shared_scratch(spark, f"queries/src5-{uuid.uuid4().hex}")
    C.write_csv(tb.mail_subject(spark, d), path, C.UTF8)
    rows = C.read_csv_complete(spark, path)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "subject", "body", "label")


@register("shp1_union_labels", tb.with_views(
    "SELECT CAST(y AS VARCHAR) AS label FROM mail UNION ALL SELECT label FROM mail_subject", "mail", "mail_subject"))
def shp1_union_labels(spark, d):
    a = tb.mail(spark, d).select(F.col("y").cast("string").alias("label"))
    return a.unionByName(tb.mail_subject(spark, d).select("label"))


@register("shp2_dedup_keep_first", """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def shp2_dedup_keep_first(spark, d):
    docs = tb.load(spark, d, "documents")
    return S.drop_duplicates_first(docs, ["text"], ["doc_id"])


@register("shp3_balance_classes", tb.with_views(f"""
SELECT row_id, y FROM ({_rank_sql('mail', 'y', SEED)}) r
WHERE y IN (0, 1) AND rk < (SELECT min(c) FROM (SELECT count(*) AS c FROM mail WHERE y IN (0, 1) GROUP BY y))""",
                                                  "mail"))
def shp3_balance_classes(spark, d):
    return S.balance_classes(tb.mail(spark, d), "y", "row_id", (0, 1), SEED).select("row_id", "y")


@register("shp4_split_80_10_10", _split_sql(0.2, "0.5"))
def shp4_split_80_10_10(spark, d):
    return S.stratified_split(tb.mail(spark, d), "y", "row_id", 0.2, 0.5, SEED).select("row_id", "y", "split")


@register("shp5_split_70_10_20", _split_sql(0.3, "2.0 / 3.0"))
def shp5_split_70_10_20(spark, d):
    return S.stratified_split(tb.mail(spark, d), "y", "row_id", 0.3, 2 / 3, SEED).select("row_id", "y", "split")


_SHP6_REST_CLS = "SELECT y AS g, count(*) AS n_c FROM rest GROUP BY y"


@register("shp6_split_test_then_val", tb.with_views(f"""
SELECT row_id, y, 'test' AS split FROM g1 WHERE rk >= (SELECT n - n_test FROM t1)
UNION ALL
SELECT r.row_id, r.y, CASE WHEN r.rk < tr.n_train THEN 'train' ELSE 'val' END
FROM ({_rank_sql('rest', 'y', SEED + 1)}) r JOIN tr ON r.y = tr.g""", "mail", extra=[
    ("g1", _rank_sql("mail", None, SEED)),
    ("t1", "SELECT count(*) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM mail"),
    ("rest", "SELECT row_id, y FROM g1 WHERE rk < (SELECT n - n_test FROM t1)"),
    ("cls", _SHP6_REST_CLS),
    ("t2", "SELECT sum(n_c) AS n, CAST(ceil(CAST(0.125 AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_val FROM cls"),
    ("tr", _lr_sql("cls", "(SELECT n - n_val FROM t2)", "(SELECT n FROM t2)", "n_train")),
]))
def shp6_split_test_then_val(spark, d):
    df = S.split_test_then_stratified_val(tb.mail(spark, d), "y", "row_id", 0.2, 0.125, SEED)
    return df.select("row_id", "y", "split")


@register("shp7_words_only_in_phishing", tb.with_views(
    "SELECT word FROM words GROUP BY word HAVING bool_and(y = 1)", "mail", extra=[(
        "words", "SELECT y, w AS word FROM (SELECT y, unnest(regexp_split_to_array(lower(body), "
                 f"'{X.P.WS}+')) AS w FROM mail) WHERE regexp_matches(w, '^\\p{{L}}+$') AND w NOT IN {STOP_SQL}")]))
def shp7_words_only_in_phishing(spark, d):
    m = tb.mail(spark, d)
    words = m.select("y", X.explode_values(X.alpha_words(F.lower("body"))).alias("word"))
    words = words.filter(F.col("word").isNotNull())
    words = words.filter(~F.col("word").isin(*X.P.english_stopwords()))
    return S.words_only_in(words, "y", 1)


@register("shp8_lookup_with_default", tb.with_views("""
SELECT t.row_id, count(*) AS n_tokens, count(CASE WHEN coalesce(f.freq, 0) = 0 THEN 1 END) AS n_unknown,
       CAST(sum(coalesce(f.freq, 0)) AS BIGINT) AS freq_sum
FROM (SELECT row_id, unnest(list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''))
        AS token FROM mail) t
LEFT JOIN (SELECT token, count(*) AS freq FROM (
             SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS token FROM benchmark)
           WHERE token <> '' GROUP BY token) f ON t.token = f.token
GROUP BY t.row_id""", "mail"))
def shp8_lookup_with_default(spark, d):
    m = tb.mail(spark, d).select("row_id", X.explode_values(X.simple_tokens("body")).alias("token"))
    m = m.filter(F.col("token").isNotNull())
    bench = tb.load(spark, d, "benchmark").select(X.explode_values(X.simple_tokens("text")).alias("token"))
    bench = bench.filter(F.col("token").isNotNull())
    dim = bench.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    j = S.lookup_with_default(m, "token", dim, "token", "freq", 0)
    return j.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_tokens"),
                                   F.count(F.when(F.col("freq") == 0, 1)).alias("n_unknown"),
                                   F.sum("freq").cast("long").alias("freq_sum"))


@register("shp9_semi_anti_counts", """
SELECT (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_labelled,
       (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
         AS n_unlabelled""")
def shp9_semi_anti_counts(spark, d):
    docs = tb.load(spark, d, "documents").select("doc_id")
    labels = tb.load(spark, d, "labels").select("doc_id")
    semi = docs.join(labels, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n_labelled"))
    anti = docs.join(labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unlabelled"))
    # Two one-row aggregates folded into one row.
    both = semi.unionByName(anti, allowMissingColumns=True)
    return both.agg(F.max("n_labelled").alias("n_labelled"), F.max("n_unlabelled").alias("n_unlabelled"))


@register("shp10_pair_by_key", tb.with_views(
    "SELECT m.row_id, substring(m.body, 1, 300) AS preview, p.y, p.y_pred, p.conf FROM mail m "
    "JOIN pred p ON m.row_id = p.row_id", "mail", "pred"))
def shp10_pair_by_key(spark, d):
    texts = tb.mail(spark, d).select("row_id", X.preview("body").alias("preview"))
    scores = tb.pred(spark, d).select("row_id", "y", "y_pred", "conf")
    return S.pair_by_key(texts, scores, "row_id")


@register("shp11_seeded_shuffle", tb.with_views(
    f"SELECT row_id, md5('{SEED}|' || CAST(row_id AS VARCHAR)) AS shuffle_key FROM mail", "mail"))
def shp11_seeded_shuffle(spark, d):
    return S.seeded_shuffle(tb.mail(spark, d), "row_id", SEED).select("row_id", "shuffle_key")


def _scratch(spark, name: str) -> str:
    import uuid

    from mailsift.session import shared_scratch
    return shared_scratch(spark, f"queries/{name}-{uuid.uuid4().hex}")


@register("shp12_fresh_index", """
SELECT _file_ord, doc_id, item_id,
       row_number() OVER (ORDER BY _file_ord, coalesce(doc_id, item_id)) - 1 AS row_idx
FROM (SELECT 0 AS _file_ord, doc_id, NULL::BIGINT AS item_id FROM documents
      UNION ALL SELECT 1, NULL::BIGINT, item_id FROM benchmark)""")
def shp12_fresh_index(spark, d):
    """SHP-12: documents and benchmark passages concatenated, then a fresh
    0..n-1 index in concatenation order (file, then key)."""
    docs = tb.load(spark, d, "documents").select("doc_id")
    bench = tb.load(spark, d, "benchmark").select("item_id")
    both = S.union_tables([docs, bench]).withColumn("_key", F.coalesce("doc_id", "item_id"))
    idx = S.fresh_index(both, ["_file_ord", "_key"], _scratch(spark, "shp12"))
    return idx.select("_file_ord", "doc_id", "item_id", "row_idx")


@register("shp13_split_folders", _split_sql(0.2, "0.5"))
def shp13_split_folders(spark, d):
    """SHP-13: the named splits kept together as one table written with one
    folder per split, read back whole (a split filter prunes folders)."""
    path = _scratch(spark, "shp13")
    S.write_splits(S.stratified_split(tb.mail(spark, d), "y", "row_id", 0.2, 0.5, SEED).select("row_id", "y", "split"),
                   path)
    return spark.read.parquet(path).select("row_id", "y", "split")
