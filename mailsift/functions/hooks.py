"""User-code hooks (UDF-1, UDF-2). UDF-3 is ``operators.evaluate.metric_rows``
and UDF-4 ``operators.models.external_scorer``.

Built-in column functions are the fast path and cover every per-value step
of the engine. These hooks are for a user's own Python code that has no
built-in equivalent; both always run on Arrow batches, never row by row.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def series_apply(fn: Callable, return_type: DataType | str) -> Callable[[Column], Column]:
    """UDF-1: ``Series.apply(fn)`` as a column function: ``fn`` runs per
    value on Arrow batches in the Python workers; nulls stay null."""
    @F.pandas_udf(return_type)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")
    return apply


FRAME_BYTES = 8 << 20


def _frames(batch: pd.DataFrame, limit: int = FRAME_BYTES) -> Iterator[pd.DataFrame]:
    """``batch`` in frames of consecutive rows, each of ``limit`` bytes at most or one row."""
    sizes = sum((c.map(sys.getsizeof) for _, c in batch.items() if c.dtype == object), pd.Series(0, batch.index)).to_list()
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.iloc[begin:i].reset_index(drop=True)
            begin, held = i, 0
        held += size
    yield batch if begin == 0 else batch.iloc[begin:].reset_index(drop=True)


def batch_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """UDF-2: ``dataset.map(fn, batched=True)``: ``fn`` receives each Arrow
    batch of a partition as a pandas frame and returns a frame with
    ``schema``; it may add, drop or change columns (and rows). An Arrow batch is
    cut by rows into frames of at most ``FRAME_BYTES`` (a single row may have
    more), so that what ``fn`` builds does not grow with the texts of a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _frames(b):
                yield fn(part)
    return df.mapInPandas(run, schema)
