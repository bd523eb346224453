"""Training-log analytics (LOG-1 ... LOG-5, MOD-5 over a run-metrics table).

A log is a table of rows with ``step`` (the log order), an optional ``epoch``
and either a train ``loss`` or eval metrics. The carry-forward of the last
seen epoch is a running "last non-null" over the log order; it is computed
block-wise so no single task has to see the whole log: each block of
``block`` consecutive steps runs its own window, and the value carried into a
block comes from a per-block table, scanned in blocks itself where it is long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.session import handoff


def train_loss_by_step(log: DataFrame, step: str = "step", loss: str = "loss") -> DataFrame:
    """LOG-1: (step, loss) of train rows, in step order."""
    return log.filter(F.col(loss).isNotNull() & F.col(step).isNotNull()).select(step, loss).orderBy(step)


def eval_by_epoch(log: DataFrame, epoch: str = "epoch") -> DataFrame:
    """LOG-2: eval rows with the epoch rounded half to even."""
    return (log.filter(F.col("eval_loss").isNotNull())
               .select(F.bround(F.col(epoch), 0).cast("long").alias("epoch"), "eval_loss", "eval_accuracy", "step"))


def carry_forward(log: DataFrame, col: str, order: str = "step", out: str | None = None,
                  block: int = 1 << 20) -> DataFrame:
    """``out`` = the last non-null ``col`` at or before each row in ``order``.

    ``order`` must be a unique integer; rows without one get null. Rows are cut
    into blocks of ``block`` consecutive order values, and a block's last value is
    one row of a summary. The value carried into a block is found on the summary
    in the same way, level by level, until a summary has at most ``block`` rows:
    no window sees more than that."""
    return _scan(log, col, order, out or f"{col}_ff", block, 0, 0)


def _scan(rows: DataFrame, col: str, order: str, out: str, block: int, end: int, level: int) -> DataFrame:
    """``rows`` with ``out``: the last non-null ``col`` up to the row (``end`` 0) or before it (-1)."""
    blk, last, carry, inner = (f"_{name}{level}" for name in ("blk", "last", "carry", "in"))
    keyed = rows.withColumn(blk, F.expr(f"`{order}` div {block}L"))
    seen = F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))
    summary = handoff(keyed.where(F.col(blk).isNotNull()).groupBy(blk).agg(seen.alias(last)), "blocks")
    if summary.count() > block:
        carried = _scan(summary, last, blk, carry, block, -1, level + 1)
    else:
        before = Window.orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
        carried = summary.withColumn(carry, F.last(last, ignorenulls=True).over(before))
    within = Window.partitionBy(blk).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    found = keyed.where(F.col(blk).isNotNull()).withColumn(inner, F.last(F.col(col), ignorenulls=True).over(within))
    found = found.join(carried.select(blk, carry), blk, "left").withColumn(out, F.coalesce(inner, carry))
    without = keyed.where(F.col(blk).isNull()).withColumn(out, F.lit(None).cast(rows.schema[col].dataType))
    columns = [*(c for c in rows.columns if c != out), out]
    return found.select(*columns).unionByName(without.select(*columns))


def mean_train_loss_per_epoch(log: DataFrame, epoch: str = "epoch", loss: str = "loss", order: str = "step",
                              block: int = 1 << 20) -> DataFrame:
    """LOG-3: train loss averaged per epoch ``max(1, ceil(last seen epoch))``
    (epoch 1 before any epoch has been seen)."""
    ff = carry_forward(log, epoch, order, "_ep", block)
    key = F.greatest(F.lit(1), F.coalesce(F.ceil("_ep"), F.lit(1))).cast("long")
    return (ff.filter(F.col(loss).isNotNull())
              .groupBy(key.alias("epoch")).agg(F.avg(loss).alias("train_loss")))


def align_curves(log: DataFrame, block: int = 1 << 20) -> DataFrame:
    """LOG-4: per-epoch train loss (LOG-3) beside validation loss and
    accuracy (LOG-2, averaged per rounded epoch), full outer join on epoch."""
    train = mean_train_loss_per_epoch(log, block=block)
    val = (eval_by_epoch(log).filter(F.col("epoch").isNotNull()).groupBy("epoch")
           .agg(F.avg("eval_loss").alias("val_loss"), F.avg("eval_accuracy").alias("val_accuracy")))
    return train.join(val, "epoch", "full")


def train_points(log: DataFrame) -> DataFrame:
    """LOG-5: (step, epoch, loss) wherever a loss is present, unaligned."""
    return log.filter(F.col("loss").isNotNull()).select("step", "epoch", "loss").orderBy("step")


def best_epoch(metrics: DataFrame, metric: str, epoch: str = "epoch", tiebreak: str = "step") -> DataFrame:
    """MOD-5: the row with the best metric; among equal values the latest
    (``>=`` keeps the last one seen). A top-1, no full sort."""
    return metrics.filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), F.col(tiebreak).desc()).limit(1)
