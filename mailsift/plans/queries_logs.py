"""Training-log queries: LOG-1 ... LOG-5 and MOD-5 (best epoch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import logs as G
from mailsift.plans.registry import register
from mailsift.sources import tables as tb

_TRAIN_SQL = ("tr", """
SELECT CAST(greatest(1, coalesce(ceil(ep), 1)) AS BIGINT) AS epoch, avg(loss) AS train_loss FROM (
  SELECT loss, last_value(epoch IGNORE NULLS) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS ep FROM log) WHERE loss IS NOT NULL GROUP BY 1""")
_VAL_SQL = ("va", """
SELECT CAST(round_even(epoch, 0) AS BIGINT) AS epoch, avg(eval_loss) AS val_loss, avg(eval_accuracy) AS val_accuracy
FROM log WHERE eval_loss IS NOT NULL AND epoch IS NOT NULL GROUP BY 1""")


@register("log1_train_loss_by_step", tb.with_views(
    "SELECT step, loss FROM log WHERE loss IS NOT NULL AND step IS NOT NULL", "log"))
def log1_train_loss_by_step(spark, d):
    return G.train_loss_by_step(tb.log(spark, d))


@register("log2_eval_by_epoch", tb.with_views(
    "SELECT CAST(round_even(epoch, 0) AS BIGINT) AS epoch, eval_loss, eval_accuracy, step FROM log "
    "WHERE eval_loss IS NOT NULL", "log"))
def log2_eval_by_epoch(spark, d):
    return G.eval_by_epoch(tb.log(spark, d))


@register("log3_mean_train_loss_per_epoch", tb.with_views(
    "SELECT epoch, round(train_loss, 9) AS train_loss FROM tr", "log", extra=[_TRAIN_SQL]))
def log3_mean_train_loss_per_epoch(spark, d):
    m = G.mean_train_loss_per_epoch(tb.log(spark, d))
    return m.select("epoch", F.round("train_loss", 9).alias("train_loss"))


@register("log4_align_curves", tb.with_views(
    "SELECT coalesce(tr.epoch, va.epoch) AS epoch, round(train_loss, 9) AS train_loss, round(val_loss, 9) AS val_loss, "
    "round(val_accuracy, 9) AS val_accuracy FROM tr FULL OUTER JOIN va ON tr.epoch = va.epoch",
    "log", extra=[_TRAIN_SQL, _VAL_SQL]))
def log4_align_curves(spark, d):
    a = G.align_curves(tb.log(spark, d))
    return a.select("epoch", *[F.round(c, 9).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")])


@register("log5_train_points", tb.with_views("SELECT step, epoch, loss FROM log WHERE loss IS NOT NULL", "log"))
def log5_train_points(spark, d):
    return G.train_points(tb.log(spark, d))


@register("mod5_best_epoch", tb.with_views(
    "SELECT CAST(round_even(epoch, 0) AS BIGINT) AS epoch, eval_accuracy, step FROM log "
    "WHERE eval_loss IS NOT NULL AND eval_accuracy IS NOT NULL ORDER BY eval_accuracy DESC, step DESC LIMIT 1",
    "log"))
def mod5_best_epoch(spark, d):
    return G.best_epoch(G.eval_by_epoch(tb.log(spark, d)), "eval_accuracy").select("epoch", "eval_accuracy", "step")
