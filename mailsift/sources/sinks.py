"""Sinks: vocabulary, label map, run metadata, models, reports (SNK-1 ... SNK-4).

Tables are written as Parquet. The JSON exports the original tools produce
(a vocabulary object, a label object) are single documents: they are built
from tables whose size is bounded (``max_size`` vocabulary rows, one row per
class) and written as one text file.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators.bow_models import BowModel


def _write_document(df: DataFrame, path: str, col: str = "value") -> None:
    df.select(col).coalesce(1).write.mode("overwrite").text(path)


def save_vocab(vocab: DataFrame, path: str) -> None:
    """SNK-1: vocabulary as Parquet plus a ``{token: id}`` JSON document."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab.parquet")
    entries = F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("token"))))
    doc = vocab.agg(entries.alias("e")).select(
        F.to_json(F.map_from_entries(F.transform("e", lambda s: F.struct(s["token"], s["id"])))).alias("value"))
    _write_document(doc, f"{path}/vocab.json")


def save_label_map(label_map: DataFrame, path: str) -> None:
    """SNK-2: ``{label: id}`` JSON document (one row per class)."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("label_id"), F.col("label"))))
    doc = label_map.agg(entries.alias("e")).select(
        F.to_json(F.map_from_entries(F.transform("e", lambda s: F.struct(s["label"], s["label_id"])))).alias("value"))
    _write_document(doc, path)


def save_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """SNK-2: run metadata (hyper-parameters) as a one-row JSON document."""
    _write_document(spark.createDataFrame([(json.dumps(meta),)], "value string"), path)


def save_meta_frame(meta: DataFrame, path: str) -> None:
    """SNK-2: a one-row table (hyper-parameters and figures computed by the
    run) as one flat JSON document, built without leaving Spark."""
    _write_document(meta.select(F.to_json(F.struct("*")).alias("value")), path)


def save_model(model: PipelineModel | BowModel, path: str) -> None:
    """SNK-3: persist a fitted model (overwrite keeps the latest best)."""
    if isinstance(model, BowModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, spark: SparkSession | None = None) -> PipelineModel | BowModel:
    """SNK-3: reload a persisted model, of whichever kind stands there."""
    spark = spark or SparkSession.active()
    return BowModel.load(spark, path) if BowModel.saved_at(spark, path) else PipelineModel.load(path)


def save_report(spark: SparkSession, report: dict | DataFrame, path: str) -> None:
    """SNK-4: the nested evaluation report (a dict, or its one row as a frame,
    which then never leaves Spark) as one JSON document."""
    from mailsift.operators.evaluate import report_frame

    row = report if isinstance(report, DataFrame) else report_frame(spark, report)
    _write_document(row.select(F.to_json(F.struct("*")).alias("value")), path)


def read_document(spark: SparkSession, path: str) -> str:
    """Read back a single-document text sink."""
    return spark.read.text(path, wholetext=True).first()[0]


def save_training_log(log: DataFrame, path: str, block: int = 500, order: str = "step") -> None:
    """Write a log table as trainer-state documents, one per block of
    ``block`` consecutive steps (a checkpoint's worth), one per line; each
    document's ``log_history`` is bounded by the block size."""
    fields = [order] + [c for c in log.columns if c != order]
    docs = (log.groupBy(F.floor(F.col(order) / block).alias("_blk"))
               .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("log_history")))
    docs.select(F.to_json(F.struct("log_history")).alias("value")).write.mode("overwrite").text(path)
