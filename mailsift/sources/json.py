"""JSON sources: label maps and training logs (SRC-8, SRC-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_FIELDS = ("epoch", "step", "loss", "grad_norm", "learning_rate", "eval_loss", "eval_accuracy")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: a JSON object ``{"label": id, ...}`` -> (label, label_id) rows."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,long>")
    return text.select(F.explode(m).alias("label", "label_id"))


def read_training_log(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC-9: trainer state documents -> one row per ``log_history`` entry,
    with ``ord`` = its position in its document. Rows are heterogeneous:
    train rows carry ``loss``, eval rows ``eval_*``; absent keys are null.
    ``multi_line=False`` reads one document per line (many runs or
    checkpoints per file)."""
    state = spark.read.option("multiLine", multi_line).json(path)
    rows = state.select(F.posexplode("log_history").alias("ord", "e"))
    present = set(rows.schema["e"].dataType.fieldNames())
    types = {"step": "long"}
    cols = [F.col(f"e.{f}").cast(types.get(f, "double")).alias(f) if f in present
            else F.lit(None).cast(types.get(f, "double")).alias(f) for f in LOG_FIELDS]
    return rows.select(F.col("ord").cast("long"), *cols)
