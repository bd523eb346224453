"""Hand-off tables and small driver-side helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsift.session import delete_path, handoff_path


def handoff(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder (``spark.checkpoint.dir``) and read it
    back: its lineage is cut, a lost executor costs nothing but a re-read, and
    the rows are computed once however often they are used."""
    path = handoff_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop_handoff(df: DataFrame) -> None:
    """Delete a hand-off table that its maker no longer reads."""
    delete_path(df.sparkSession, df._llm_path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as stored."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
