"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash of their key and ranked within their source
(r = 1..n); row r of a source with n rows stands at the fraction (r - 1/2) / n.
All rows sorted by that fraction and cut into equal runs give shards whose row
counts differ by one at most, each with the sources in the corpus's mixture.

Nothing is ranked in one task: ranks are taken in buckets of the hash (of
every source) and of the fraction, about sqrt(N) of each, and shifted by the
row counts before the bucket. The counts before a fraction bucket follow from
the sources' sizes alone, so they need no second pass; sources of one size share
that work, so a source for every few rows costs no more than the rows do.

Only DataFrame functions are used. Defined results: a null source is a source;
null keys sort as the text 'null'; rows with equal keys are ordered by ``tie``
columns; rows equal in all of these may swap places, which no column shows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shard(df: DataFrame, n_shards: int, source: str = "source", key: str = "doc_id", tie: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """The columns of ``df`` and shard (0 to n_shards - 1) and slot (place in
    the shard, gapless from 0); columns of these names in ``df`` are replaced."""
    total = df.count()
    buckets = max(1, math.ceil(math.sqrt(total)))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null")).alias("src"), shuffled.alias("h"))
    rows = rows.withColumn("part", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long"))
    counts = rows.groupBy("src", "part").agg(F.count("*").alias("c"))
    by_src = Window.partitionBy("src")
    before = counts.select("src", "part", F.sum("c").over(by_src.orderBy("part")).alias("upto"), "c", F.sum("c").over(by_src).alias("n"))
    within = Window.partitionBy("src", "part").orderBy("h", *(F.col(f"row.{t}") for t in tie))
    ranked = (rows.join(before.select("src", "part", (F.col("upto") - F.col("c")).alias("before"), "n"), ["src", "part"])
              .withColumn("r", F.col("before") + F.row_number().over(within))
              .withColumn("bucket", F.expr(f"((2 * r - 1) * {buckets}L) div (2 * n)")))
    # Rows of a source below fraction b / buckets: those with (2 r - 1) * buckets < 2 b n. A source's
    # size alone says where its rows fall, so sources of one size are laid out together, and only
    # over the buckets that hold a row of theirs: never more cells than rows, however many sources.
    sizes = counts.groupBy("src").agg(F.sum("c").alias("n")).groupBy("n").agg(F.count("*").alias("m"))
    below = lambda b: f"IF({b} = 0, 0L, ((2L * {b} * n - 1) div {buckets}L + 1) div 2)"
    cells = sizes.select("n", "m", F.explode(F.expr(f"sequence(1L, least(n, {buckets}L))")).alias("i"))
    filled = (cells.select(F.expr(f"IF(n < {buckets}, ((2 * i - 1) * {buckets}L) div (2 * n), i - 1)").alias("bucket"),
                           F.expr(f"m * IF(n < {buckets}, 1L, {below('i')} - {below('(i - 1)')})").alias("c"))
              .groupBy("bucket").agg(F.sum("c").alias("c")))
    # One row a bucket, about sqrt(N): small enough for one running total.
    starts = filled.select("bucket", (F.sum("c").over(Window.orderBy("bucket")) - F.col("c")).alias("start"))
    in_bucket = Window.partitionBy("bucket").orderBy((F.col("r") * 2 - 1) / (F.col("n") * 2), "src", "r")
    placed = ranked.join(starts, "bucket").withColumn("at", F.col("start") + F.row_number().over(in_bucket) - 1)
    out = placed.withColumn("shard", F.expr(f"CAST((at * {n_shards}L) div {max(total, 1)}L AS INT)"))
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in ("shard", "slot")]
    return out.select(*kept, "shard", F.expr(f"at - (shard * {total}L + {n_shards - 1}) div {n_shards}L").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order within a file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
