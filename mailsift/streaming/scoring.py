"""Structured Streaming re-aims of the scoring endpoint (STR-1, STR-2).

Evaluation files arrive in a folder; each micro-batch runs the same column
functions as the batch path (subject + body, label ids, valid filter, model
scoring, threshold verdict). Checkpoints live in the shared checkpoint folder
so a restarted driver or a lost executor resumes without reprocessing or
losing files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators import labels as L
from mailsift.session import shared_scratch
from mailsift.sources import csv as C

EVAL_COLUMNS = ("subject", "body", "label")
DEFAULT_LABEL2ID = {v: k for k, v in P.DEFAULT_ID2LABEL.items()}
STRING_KIND = {"kind": "string", "has_null": True, "frac": False}


def arriving_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The paths of the CSV files that land in ``folder``; contents are not read."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[cC][sS][vV]")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder).select("path")


def read_arrived(batch: DataFrame, columns: Sequence[str] = EVAL_COLUMNS) -> DataFrame | None:
    """The rows of a batch of arriving files (their paths, at most the files of
    one trigger), columns by each file's header; None for a batch without files.
    A file that lacks a column raises, by name."""
    paths = [r["path"] for r in batch.collect()]
    return C.read_csv_by_name(batch.sparkSession, paths, columns) if paths else None


def prepare_eval_rows(df: DataFrame, label2id: Mapping[str, int] = DEFAULT_LABEL2ID) -> DataFrame:
    """PRJ-4 + LBL-3 + PRJ-7 as stateless column work (the label column of a
    CSV stream is text, so its kind is fixed instead of inferred)."""
    t = df.withColumn("text", X.subject_body_block("subject", "body"))
    t = L.label_ids(t, "label", label2id, STRING_KIND)
    return t.filter(F.col("y_true").isNotNull())


def score_rows(model, df: DataFrame, text_col: str = "body", threshold: int = 50,
               positive: int = 1) -> DataFrame:
    """EVL-1 + EVL-13 verdict: model scores, confidence, phishing if the
    positive-class probability is at least ``threshold``/100."""
    out = model.transform(df.withColumn(text_col, F.col("text")) if text_col != "text" else df)
    probs = vector_to_array(F.col("probability"))
    return (out.withColumn("y_pred", F.col("prediction").cast("int"))
               .withColumn("conf", F.array_max(probs))
               .withColumn("score", probs[positive])
               .withColumn("verdict", F.when(F.col("score") >= threshold / 100.0, F.lit(P.PHISHING))
                           .otherwise(F.lit(P.LEGITIMATE))))


def _run(files: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    w = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def _batch_folder(out: str, number: int) -> str:
    return f"{out}/batch={number}"


def score_stream(spark: SparkSession, folder: str, model, out: str, checkpoint: str | None = None,
                 threshold: int = 50, available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """STR-1: arriving CSVs -> clean columns -> score -> verdict -> Parquet, one
    folder a batch (column ``batch``)."""
    def each(batch: DataFrame, number: int) -> None:
        arrived = read_arrived(batch)
        if arrived is not None:
            rows = score_rows(model, prepare_eval_rows(arrived), threshold=threshold)
            rows.select("subject", "body", "label", "y_true", "y_pred", "conf", "score", "verdict").write.mode("overwrite").parquet(_batch_folder(out, number))

    return _run(arriving_files(spark, folder, max_files_per_trigger), each, checkpoint or shared_scratch(spark, "streams/score"), available_now)


def running_confusion(spark: SparkSession, folder: str, model, out: str, checkpoint: str | None = None,
                      available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """STR-2: confusion counts of each batch of arriving mail, kept in the table
    at ``out`` under the batch's number (K x K rows at most); a batch that runs
    again replaces its own counts only. ``confusion_so_far`` sums them."""
    def each(batch: DataFrame, number: int) -> None:
        arrived = read_arrived(batch)
        if arrived is not None:
            count_batch(score_rows(model, prepare_eval_rows(arrived)), out, number)

    return _run(arriving_files(spark, folder, max_files_per_trigger), each, checkpoint or shared_scratch(spark, "streams/confusion"), available_now)


def count_batch(scored: DataFrame, out: str, number: int) -> None:
    """Merge the counts of batch ``number`` into the table at ``out``."""
    counts = scored.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(_batch_folder(out, number))


def confusion_so_far(spark: SparkSession, out: str) -> DataFrame:
    """(y_true, y_pred, n) over all batches so far."""
    return spark.read.schema("y_true int, y_pred int, n long, batch long").parquet(out).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))
