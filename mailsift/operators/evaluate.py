"""Scoring and evaluation (EVL-2 ... EVL-13).

Every classification metric is derived from one ``groupBy(y, y_pred).count()``
table (at most K x K rows, map-side combined), so the full data is scanned
once; everything after that works on a handful of rows. Zero divisions give
0, as the original reports do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.session import handoff


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------
# EVL-2: softmax / argmax
# --------------------------------------------------------------------------
def softmax(logits: Column | str) -> Column:
    lg = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(values: Column | str) -> Column:
    """Index of the first maximum (0-based)."""
    v = F.col(values) if isinstance(values, str) else values
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def with_predictions(df: DataFrame, logits: str, probs: str = "probs", pred: str = "y_pred",
                     conf: str = "conf") -> DataFrame:
    """EVL-2: probabilities, predicted id (first max wins), confidence."""
    out = df.withColumn(probs, softmax(logits))
    return out.withColumn(pred, argmax(logits)).withColumn(conf, F.array_max(probs))


# --------------------------------------------------------------------------
# EVL-3 ... EVL-8
# --------------------------------------------------------------------------
def accuracy(df: DataFrame, y: str = "y", yp: str = "y_pred") -> DataFrame:
    """EVL-3."""
    return df.agg(F.avg((F.col(y) == F.col(yp)).cast("double")).alias("accuracy"))


def pair_counts(df: DataFrame, y: str = "y", yp: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n) for the pairs that occur."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(yp).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def _label_frame(spark: SparkSession, labels: Sequence[int], names: Mapping[int, str] | None) -> DataFrame:
    names = names or {}
    return spark.createDataFrame([(int(c), names.get(c)) for c in labels], "class_id int, class_name string")


def confusion_matrix(df: DataFrame, labels: Sequence[int], y: str = "y", yp: str = "y_pred",
                     counts: DataFrame | None = None) -> DataFrame:
    """EVL-4: dense, zero-filled confusion counts over a fixed label order.
    The label grid is a local K x K relation built from the label list."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(int(a), int(b)) for a in labels for b in labels], "y_true int, y_pred int")
    c = counts if counts is not None else pair_counts(df, y, yp)
    return grid.join(c, ["y_true", "y_pred"], "left").select("y_true", "y_pred",
                                                             F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(df: DataFrame, labels: Sequence[int], names: Mapping[int, str] | None = None, y: str = "y",
              yp: str = "y_pred", counts: DataFrame | None = None) -> DataFrame:
    """EVL-5: precision / recall / F1 / support per class."""
    spark = df.sparkSession
    c = counts if counts is not None else pair_counts(df, y, yp)
    support = c.groupBy(F.col("y_true").alias("class_id")).agg(F.sum("n").alias("support"))
    predicted = c.groupBy(F.col("y_pred").alias("class_id")).agg(F.sum("n").alias("predicted"))
    tp = c.filter(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("class_id"), F.col("n").alias("tp"))
    t = (_label_frame(spark, labels, names).join(support, "class_id", "left").join(predicted, "class_id", "left")
         .join(tp, "class_id", "left").fillna(0, ["support", "predicted", "tp"]))
    tp_, sup, pred = F.col("tp").cast("double"), F.col("support").cast("double"), F.col("predicted").cast("double")
    return t.select("class_id", "class_name",
                    _safe_div(tp_, pred).alias("precision"),
                    _safe_div(tp_, sup).alias("recall"),
                    _safe_div(2 * tp_, sup + pred).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def macro_average(pc: DataFrame) -> DataFrame:
    """EVL-6: unweighted mean over classes."""
    return pc.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def binary_scores(pc: DataFrame, positive: int = 1) -> DataFrame:
    """EVL-7: P / R / F1 of the positive class."""
    return pc.filter(F.col("class_id") == positive).select("precision", "recall", "f1")


def metric_rows(df: DataFrame, labels: Sequence[int], y: str = "y", yp: str = "y_pred",
                average: str = "macro", positive: int = 1) -> DataFrame:
    """UDF-3: the metric callback of a training loop as (metric, value) rows:
    accuracy and macro- or binary-averaged precision / recall / F1."""
    counts = pair_counts(df, y, yp)
    pc = per_class(df, labels, None, y, yp, counts)
    avg = macro_average(pc) if average == "macro" else binary_scores(pc, positive)
    acc = counts.agg(_safe_div(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
                               .cast("double"), F.sum("n").cast("double")).alias("accuracy"))
    return (acc.select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
            .unionByName(avg.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                        for m in ("precision", "recall", "f1")])).alias("m"))
                         .select("m.metric", "m.value")))


def classification_report(df: DataFrame, labels: Sequence[int], names: Mapping[int, str] | None = None,
                          y: str = "y", yp: str = "y_pred") -> DataFrame:
    """EVL-8: per class, then accuracy, macro avg and support-weighted avg."""
    counts = pair_counts(df, y, yp)
    pc = per_class(df, labels, names, y, yp, counts)
    rows = pc.select(F.coalesce("class_name", F.col("class_id").cast("string")).alias("row"),
                     "precision", "recall", "f1", "support")
    total = counts.agg(F.sum("n").alias("support"),
                       F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    acc = total.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                       F.lit(None).cast("double").alias("recall"),
                       _safe_div(F.col("hit").cast("double"), F.col("support").cast("double")).alias("f1"),
                       F.col("support").cast("long").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    w = F.col("support").cast("double")
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      _safe_div(F.sum(F.col("precision") * w), F.sum(w)).alias("precision"),
                      _safe_div(F.sum(F.col("recall") * w), F.sum(w)).alias("recall"),
                      _safe_div(F.sum(F.col("f1") * w), F.sum(w)).alias("f1"), F.sum("support").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


# --------------------------------------------------------------------------
# EVL-9 / EVL-10: the evaluation report of the scoring endpoint
# --------------------------------------------------------------------------
def _report_state(scored: DataFrame, order: Sequence[str], y: str, yp: str, conf: str, text: str, k: int) -> DataFrame:
    """One row: n, hit, cells (array of y, p, n), errors (the first ``k`` in
    input order) and before (the valid rows in front of each of them).

    The first errors are a top-k inside a scalar subquery; the pairs and the rows
    in front of the errors are counters of one hash aggregate with map-side
    combine, so nothing is sorted as a whole and no part reaches the driver.
    How many rows stand before an error is known only once the error is, so
    ``scored`` is read twice within the one query."""
    rows = scored.select(F.struct(*order).alias("key"), F.col(y).cast("long").alias("y"), F.col(yp).cast("long").alias("p"),
                         F.col(conf).cast("double").alias("conf"), F.substring(F.col(text), 1, 300).alias("preview"))
    first = rows.filter("y <> p").orderBy("key").limit(k)
    errors = first.agg(F.sort_array(F.collect_list(F.struct("key", "y", "p", "conf", "preview")))).scalar()
    marked = rows.select("key", "y", "p", errors.alias("errors"))
    counted = marked.groupBy("y", "p").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("key") < F.get("errors", F.lit(i))["key"]).alias(f"b{i}") for i in range(k)])
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))), F.lit(0)).alias("hit"),
        F.collect_list(F.struct("y", "p", "n")).alias("cells"),
        F.array(*[F.sum(f"b{i}") for i in range(k)]).alias("before")).withColumn("errors", errors)


def _examples(id2label: Mapping[int, str]) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in id2label.items() for x in (int(k), v)])

    def one(e: Column, i: Column) -> Column:
        return F.struct(F.get("before", i).alias("index_in_valid"),
                        F.try_element_at(names, e["y"].cast("int")).alias("true"),
                        F.try_element_at(names, e["p"].cast("int")).alias("pred"),
                        F.bround(e["conf"], 4).alias("confidence"), e["preview"].alias("preview"))

    return F.transform("errors", one)


def misclassified(df: DataFrame, order: Sequence[str], y: str = "y_true", yp: str = "y_pred", conf: str = "conf",
                  text: str = "text", k: int = 10, id2label: Mapping[int, str] | None = None) -> DataFrame:
    """EVL-10: the first ``k`` misclassified rows in input order with their
    position among the valid rows (``order`` is unique per row)."""
    id2label = dict(P.DEFAULT_ID2LABEL if id2label is None else id2label)
    return _report_state(df, order, y, yp, conf, text, k).select(F.inline(_examples(id2label)))


def evaluation_frame(scored: DataFrame, rows_in: DataFrame | int | None = None, order: Sequence[str] = ("row_id",),
                     y: str = "y_true", yp: str = "y_pred", conf: str = "conf", text: str = "text",
                     id2label: Mapping[int, str] | None = None) -> DataFrame:
    """EVL-9 as one lazy row of ``REPORT_SCHEMA``: rows in, rows used, label
    map, accuracy, per-class report, confusion matrix and the first
    misclassified rows.

    ``scored`` holds the valid rows only (label id not null) and is read twice
    (see ``_report_state``): hand it off first where scoring is expensive.
    ``rows_in`` is the table before that filter, or its row count. Without a
    valid row the counts and rates are 0 and there are no examples."""
    id2label = dict(P.DEFAULT_ID2LABEL if id2label is None else id2label)
    labels = sorted(id2label)
    state = _report_state(scored, order, y, yp, conf, text, 10)
    ids = F.array(*[F.lit(int(c)) for c in labels])
    names = F.create_map(*[F.lit(x) for k, v in id2label.items() for x in (int(k), v)])

    def pair(a: Column, b: Column) -> Column:
        return F.concat_ws(",", *[F.coalesce(v.cast("string"), F.lit("null")) for v in (a, b)])

    def total(side: str, a: Column) -> Column:
        return F.aggregate(F.filter("cells", lambda c: c[side] == a), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])

    state = state.withColumn("by_pair", F.map_from_entries(F.transform("cells", lambda c: F.struct(pair(c["y"], c["p"]), c["n"]))))

    def cell(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_element_at("by_pair", pair(a, b)), F.lit(0).cast("long"))

    def scores(c: Column) -> Column:
        tp, support, predicted = cell(c, c).cast("double"), total("y", c), total("p", c)
        return F.struct(c.alias("class_id"), F.try_element_at(names, c).alias("class_name"),
                        F.bround(_safe_div(tp, predicted.cast("double")), 4).alias("precision"),
                        F.bround(_safe_div(tp, support.cast("double")), 4).alias("recall"),
                        F.bround(_safe_div(2 * tp, (support + predicted).cast("double")), 4).alias("f1"),
                        support.alias("support"))

    n_rows = rows_in.agg(F.count(F.lit(1))).scalar() if isinstance(rows_in, DataFrame) else F.col("n") if rows_in is None else F.lit(rows_in)
    return state.select(
        n_rows.cast("long").alias("n_rows"), F.col("n").alias("n_used_for_eval"), names.alias("labels"),
        F.bround(_safe_div(F.col("hit").cast("double"), F.col("n").cast("double")), 4).alias("accuracy"),
        F.transform(ids, scores).alias("per_class"),
        F.struct(F.array(*[F.lit(id2label[c]) for c in labels]).alias("labels_order"),
                 F.transform(ids, lambda a: F.transform(ids, lambda b: cell(a, b))).alias("matrix")).alias("confusion_matrix"),
        _examples(id2label).alias("examples_misclassified"))


def evaluation_report(scored: DataFrame, rows_in: DataFrame | int | None = None, order: Sequence[str] = ("row_id",),
                      y: str = "y_true", yp: str = "y_pred", conf: str = "conf", text: str = "text",
                      id2label: Mapping[int, str] | None = None) -> dict:
    """EVL-9 as a nested dict: the one row of ``evaluation_frame``."""
    rep = evaluation_frame(scored, rows_in, order, y, yp, conf, text, id2label).first().asDict(recursive=True)
    if rep["n_used_for_eval"] == 0:
        raise ValueError("No valid labels after normalization.")
    return rep


REPORT_SCHEMA = (
    "n_rows long, n_used_for_eval long, labels map<int,string>, accuracy double, "
    "per_class array<struct<class_id:int,class_name:string,precision:double,recall:double,f1:double,support:long>>, "
    "confusion_matrix struct<labels_order:array<string>,matrix:array<array<long>>>, "
    "examples_misclassified array<struct<index_in_valid:long,true:string,pred:string,confidence:double,"
    "preview:string>>")


# Reading a report back from JSON: object keys are strings.
REPORT_JSON_SCHEMA = REPORT_SCHEMA.replace("map<int,string>", "map<string,string>")


def report_frame(spark: SparkSession, report: dict) -> DataFrame:
    """The nested report as a one-row DataFrame (for ``to_json`` / sinks)."""
    return spark.createDataFrame([report], REPORT_SCHEMA)


# --------------------------------------------------------------------------
# EVL-11 ... EVL-13
# --------------------------------------------------------------------------
def epoch_metrics(batches: DataFrame, epoch: str, loss: str, size: str, correct: str) -> DataFrame:
    """EVL-11: per epoch, size-weighted mean loss and accuracy of batch rows."""
    s = F.col(size).cast("double")
    return batches.groupBy(epoch).agg(
        (F.sum(F.col(loss) * s) / F.sum(s)).alias("loss"),
        (F.sum(F.col(correct).cast("double")) / F.sum(s)).alias("accuracy"))


def cross_entropy(df: DataFrame, y: str, probs: str, weights: DataFrame | None = None,
                  weight_label: str = "label") -> DataFrame:
    """EVL-12: mean ``-ln p_y``; with class weights (one row per class,
    handed off so that their size is known) also ``sum(w_y * -ln p_y) / sum(w_y)``."""
    nll = -F.log(F.element_at(F.col(probs), F.col(y) + 1))
    if weights is None:
        return df.agg(F.avg(nll).alias("cross_entropy"))
    wt = handoff(weights.select(F.col(weight_label).alias("_wl"), F.col("weight").alias("_w")), "weights")
    j = df.join(wt, F.col(y) == F.col("_wl"))
    return j.agg(F.avg(nll).alias("cross_entropy"),
                 (F.sum(F.col("_w") * nll) / F.sum("_w")).alias("cross_entropy_weighted"))


def threshold_sweep(df: DataFrame, score: str = "score", y: str = "y", positive: int = 1,
                    steps: int = 100) -> DataFrame:
    """EVL-13: verdict ``score >= t/steps`` for t = 0..steps; precision and
    recall of each threshold.

    Each row is mapped to the highest threshold it clears (exactly, with the
    same double comparison the verdict uses), counted per threshold (at most
    steps + 2 groups), then accumulated from the top over that small table."""
    spark = df.sparkSession
    s = F.col(score)
    b = F.floor(s * steps)
    t_hi = (F.when(s >= (b + 1).cast("double") / steps, b + 1)
             .when(s < b.cast("double") / steps, b - 1).otherwise(b))
    t_hi = F.when(t_hi > steps, steps).when(t_hi < -1, -1).otherwise(t_hi).cast("long")
    is_pos = (F.col(y) == positive).cast("long")
    hist = df.groupBy(t_hi.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(is_pos).alias("n_pos"))
    # The grid starts at -1 so the running sum at its bottom is the total.
    grid = spark.range(-1, steps + 1).withColumnRenamed("id", "t")
    w = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = (grid.join(hist, "t", "left").fillna(0, ["n", "n_pos"])
               .withColumn("n_flagged", F.sum("n").over(w)).withColumn("tp", F.sum("n_pos").over(w))
               .withColumn("total_pos", F.max("tp").over(Window.partitionBy())))
    tp, flagged = F.col("tp").cast("double"), F.col("n_flagged").cast("double")
    return cum.filter(F.col("t") >= 0).select(
        "t", F.col("n_flagged").cast("long").alias("n_flagged"), F.col("tp").cast("long").alias("tp"),
        _safe_div(tp, flagged).alias("precision"), _safe_div(tp, F.col("total_pos").cast("double")).alias("recall"))
