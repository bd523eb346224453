"""Driver tables and the mail-shaped views derived from them.

The driver ships TPC-H-style parquet tables plus text tables. The views below
give them the shapes the engine works on (labelled mail, mail with subject,
scored mail, a training log). Each view is defined once as a SQL expression
fragment and used both by the Spark query (through ``F.expr``) and by the
DuckDB oracle (``VIEW_SQL``), so the two sides cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Text tables and their keys. Per-row work on text (regexes, the Arrow step)
# is heavy, and a small file is a single row group, i.e. a single task. Such
# a table is hash-spread by its key over twice the cluster's cores; a large
# input already has more partitions than that and is left as it is. Hashing
# on the key (not round-robin) keeps a recomputed partition identical.
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def spread(df: DataFrame, key: str, target: int | None = None) -> DataFrame:
    """Hash-spread ``df`` by ``key`` when it has fewer partitions than
    ``target`` (default: twice the cluster's cores); otherwise unchanged."""
    target = target or 2 * df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    return df.repartition(target, key) if n < target else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = SPREAD_KEYS.get(name)
    return spread(df, key) if key else df


# --------------------------------------------------------------------------
# Shared expression fragments (valid in Spark SQL and DuckDB).
# --------------------------------------------------------------------------
_PHISH_SPELLINGS = ["phishing", "SPAM", " Phish ", "1", "TRUE", "yes", "Malicious", "fraud", "scam", "bad"]
_LEGIT_SPELLINGS = ["legitimate", " Ham ", "Safe Email", "0", "false", "NO", "benign", "clean", "safe", "good"]


def _case_by_mod(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


# Raw label spellings of `mail` (mixed column: the string branch of LBL-1).
RAW_LABEL_SQL = (f"CASE WHEN row_id % 13 = 5 THEN NULL WHEN y = 1 THEN {_case_by_mod('row_id', _PHISH_SPELLINGS)} "
                 f"ELSE {_case_by_mod('row_id', _LEGIT_SPELLINGS)} END")
# An all-numeric label column (the numeric branch), with 0.5 and -1 injected.
NUM_LABEL_SQL = ("CASE WHEN row_id % 17 = 3 THEN 0.5 WHEN row_id % 19 = 7 THEN -1.0 "
                 "ELSE CAST(y AS DOUBLE) END")
# Deterministic pseudo-score for model-free evaluation queries.
SCORE_SQL = "CAST(y * 30 + (row_id * 37) % 71 AS DOUBLE) / 100.0"
# mail_subject (from conversations).
SUBJECT_SQL = "CASE WHEN turn % 3 = 0 THEN NULL ELSE role END"
SUBJ_BODY_SQL = "CASE WHEN turn % 5 = 4 THEN NULL ELSE text END"
SUBJ_LABEL_SQL = ("CASE WHEN conv_id % 11 = 0 THEN NULL "
                  "WHEN role = 'user' THEN CASE turn % 3 WHEN 0 THEN 'phishing' WHEN 1 THEN 'PHISHING' ELSE '1' END "
                  "WHEN role = 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'legitimate' WHEN 1 THEN ' Legitimate ' ELSE '0' END "
                  "ELSE role END")
# log (from events): a training log with train rows and eval rows.
LOG_EPOCH_SQL = "CASE WHEN event_id % 7 = 3 THEN NULL ELSE CAST(event_id + 1 AS DOUBLE) / 1000.0 END"
LOG_LOSS_SQL = "CASE WHEN event_id % 10 <> 0 THEN value END"
LOG_EVAL_LOSS_SQL = "CASE WHEN event_id % 10 = 0 THEN value END"
LOG_EVAL_ACC_SQL = "CASE WHEN event_id % 10 = 0 THEN 1.0 / (1.0 + value) END"
LOG_BATCH_SQL = "1 + user_id % 64"
LOG_CORRECT_SQL = "CAST(floor((1 + user_id % 64) / (1.0 + value / 100.0)) AS BIGINT)"


# --------------------------------------------------------------------------
# Spark views
# --------------------------------------------------------------------------
def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled mail: documents joined to labels (row_id, body, y)."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("body"))
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"))
    return docs.join(labels, "row_id")


def bucket_mail_tables(spark: SparkSession, sf_dir: str, folder: str, n_buckets: int,
                       prefix: str = "mailsift") -> tuple[str, str]:
    """Write ``documents`` and ``labels`` once as tables bucketed and sorted
    by ``doc_id`` (same bucket count) under ``folder`` (a shared folder).
    Every later ``mail`` join over them is a sort-merge join without an
    exchange on either side, instead of shuffling the text per query. Pick
    ``n_buckets`` so one bucket of text is ~128-256 MB."""
    names = (f"{prefix}_documents", f"{prefix}_labels")
    for name, table in zip(names, ("documents", "labels")):
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
        (df.repartition(n_buckets, "doc_id").write.mode("overwrite").bucketBy(n_buckets, "doc_id").sortBy("doc_id")
           .option("path", f"{folder.rstrip('/')}/{table}").saveAsTable(name))
    return names


def mail_bucketed(spark: SparkSession, names: tuple[str, str]) -> DataFrame:
    """``mail`` over the bucketed tables of ``bucket_mail_tables``."""
    docs = spark.table(names[0]).select(F.col("doc_id").alias("row_id"), F.col("text").alias("body"))
    labels = spark.table(names[1]).select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"))
    return docs.join(labels, "row_id")


def mail_raw_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mail`` with raw label spellings (string column) and a numeric label."""
    return (mail(spark, sf_dir)
            .withColumn("label", F.expr(RAW_LABEL_SQL))
            .withColumn("label_num", F.expr(NUM_LABEL_SQL))
            .select("row_id", "body", "label", "label_num", "y"))


def mail_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail with subject / body / label, nulls included (from conversations)."""
    conv = load(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn",
                       F.expr(SUBJECT_SQL).alias("subject"),
                       F.expr(SUBJ_BODY_SQL).alias("body"),
                       F.expr(SUBJ_LABEL_SQL).alias("label"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored mail: y (truth), score, y_pred, conf -- no model needed."""
    m = mail(spark, sf_dir).withColumn("score", F.expr(SCORE_SQL))
    return (m.withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))
             .withColumn("conf", F.greatest(F.col("score"), 1 - F.col("score"))))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log rows: step, epoch (sometimes null), loss or eval metrics."""
    ev = load(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("step"),
                     F.expr(LOG_EPOCH_SQL).alias("epoch"),
                     F.expr(LOG_LOSS_SQL).alias("loss"),
                     F.expr(LOG_EVAL_LOSS_SQL).alias("eval_loss"),
                     F.expr(LOG_EVAL_ACC_SQL).alias("eval_accuracy"),
                     F.expr(LOG_BATCH_SQL).alias("batch_size"),
                     F.expr(LOG_CORRECT_SQL).alias("n_correct"))


# --------------------------------------------------------------------------
# The same views as DuckDB CTE bodies (oracle side).
# --------------------------------------------------------------------------
VIEW_SQL = {
    "mail": "SELECT d.doc_id AS row_id, d.text AS body, l.toxic AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "mail_raw_label": f"SELECT row_id, body, {RAW_LABEL_SQL} AS label, {NUM_LABEL_SQL} AS label_num, y FROM mail",
    "mail_subject": (f"SELECT conv_id, turn, {SUBJECT_SQL} AS subject, {SUBJ_BODY_SQL} AS body, "
                     f"{SUBJ_LABEL_SQL} AS label FROM conversations"),
    "pred": ("SELECT row_id, body, y, score, CAST(score >= 0.5 AS INTEGER) AS y_pred, "
             f"greatest(score, 1 - score) AS conf FROM (SELECT *, {SCORE_SQL} AS score FROM mail)"),
    "log": (f"SELECT event_id AS step, {LOG_EPOCH_SQL} AS epoch, {LOG_LOSS_SQL} AS loss, "
            f"{LOG_EVAL_LOSS_SQL} AS eval_loss, {LOG_EVAL_ACC_SQL} AS eval_accuracy, "
            f"{LOG_BATCH_SQL} AS batch_size, {LOG_CORRECT_SQL} AS n_correct FROM events"),
}
_VIEW_DEPS = {"mail_raw_label": ["mail"], "pred": ["mail"]}


def with_views(sql: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs for ``views`` (dependencies first)."""
    order: list[str] = []
    for v in views:
        for dep in _VIEW_DEPS.get(v, []) + [v]:
            if dep not in order:
                order.append(dep)
    ctes = [f"{v} AS ({VIEW_SQL[v]})" for v in order] + [f"{n} AS ({body})" for n, body in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
