"""Label normalisation, label maps and class weights (LBL-1 ... LBL-8, PRJ-7/8).

Label maps have one row per class. They are handed off and joined without a
hint: their size is known, and Spark broadcasts them where it is small enough.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.operators.shape import fresh_index
from mailsift.session import handoff, handoff_path


# --------------------------------------------------------------------------
# Column kind of a raw label column (decided per column, as CSV inference does)
# --------------------------------------------------------------------------
def as_number(s: Column) -> Column:
    """The number a trimmed text spells, else null (a cast alone would take
    type suffixes such as ``1d``)."""
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"), s.try_cast("double"))


def label_kind(df: DataFrame, col: str) -> dict:
    """One pass over the non-null labels: is the column numeric, fractional,
    boolean, does it hold nulls. Returns a small dict (one aggregate row)."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.BooleanType):
        return {"kind": "boolean", "has_null": None, "frac": False}
    if isinstance(dtype, T.NumericType):
        r = df.agg(F.count(F.when(c.isNull(), 1)).alias("nulls"),
                   F.count(F.when(c.isNotNull() & (c != F.floor(c)), 1)).alias("frac")).first()
        floating = isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType))
        return {"kind": "numeric", "has_null": r["nulls"] > 0, "frac": floating or r["frac"] > 0}
    s = F.trim(c)
    num = as_number(s)
    r = df.agg(
        F.count(F.when(c.isNull(), 1)).alias("nulls"),
        F.count(F.when(c.isNotNull() & num.isNull(), 1)).alias("non_num"),
        F.count(F.when(num.isNotNull() & (num != F.floor(num)), 1)).alias("frac"),
        F.count(F.when(s.rlike(r"[.eE]"), 1)).alias("dotted"),
        F.count(F.when(c.isNotNull() & ~c.isin("True", "False", "TRUE", "FALSE", "true", "false"), 1)).alias("non_bool"),
        F.count(F.when(c.isNotNull(), 1)).alias("n"),
    ).first()
    if r["n"] and r["non_bool"] == 0:
        return {"kind": "boolean", "has_null": r["nulls"] > 0, "frac": False}
    if r["n"] and r["non_num"] == 0:
        return {"kind": "numeric", "has_null": r["nulls"] > 0, "frac": r["frac"] > 0 or r["dotted"] > 0}
    return {"kind": "string", "has_null": r["nulls"] > 0, "frac": False}


# --------------------------------------------------------------------------
# LBL-1 / LBL-2
# --------------------------------------------------------------------------
def _string_rules(s: Column) -> Column:
    s = F.lower(X.strip_outer_ws(s))
    return (F.when(s.isin(*P.PHISHING_WORDS), F.lit(P.PHISHING))
             .when(s.isin(*P.LEGIT_WORDS), F.lit(P.LEGITIMATE))
             .when(s.isin(*P.PHISHING_FLAGS), F.lit(P.PHISHING))
             .when(s.isin(*P.LEGIT_FLAGS), F.lit(P.LEGITIMATE))
             .otherwise(s))


def normalize_label(col: Column | str, numeric: bool) -> Column:
    """LBL-1: numeric column -> ``int(v) != 0`` is phishing (|v| >= 1, so 0.5 is
    legitimate and -1 phishing); otherwise synonym sets on the trimmed,
    lower-cased value, falling back to the value itself."""
    c = F.col(col) if isinstance(col, str) else col
    if numeric:
        v = c.cast("double")
        return F.when(v.isNull(), F.lit(None).cast("string")) \
                .when(F.abs(v) >= 1, F.lit(P.PHISHING)).otherwise(F.lit(P.LEGITIMATE))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(_string_rules(c.cast("string")))


def printed_label(col: Column | str, kind: dict) -> Column:
    """How a raw label prints: a numeric column with fractions or nulls is a
    float column, so ``1`` prints as ``1.0``."""
    c = F.col(col) if isinstance(col, str) else col
    if kind["kind"] == "numeric":
        v = as_number(F.trim(c.cast("string")))
        if kind["frac"] or kind["has_null"]:
            return v.cast("string")
        return v.cast("long").cast("string")
    if kind["kind"] == "boolean":
        return F.when(F.lower(c.cast("string")) == "true", F.lit("True")).when(c.isNotNull(), F.lit("False"))
    return c.cast("string")


def normalize_label_printed(col: Column | str, kind: dict) -> Column:
    """LBL-2: the string rules only, applied to the printed value."""
    return normalize_label(printed_label(col, kind), numeric=False)


def normalize_labels(df: DataFrame, col: str = "label", out: str | None = None) -> DataFrame:
    """LBL-1 over a table: the numeric branch is chosen by the column kind."""
    kind = label_kind(df, col)
    numeric = kind["kind"] == "numeric"
    src = as_number(F.trim(F.col(col).cast("string"))) if numeric else F.col(col)
    if kind["kind"] == "boolean":
        src = F.when(F.lower(F.col(col).cast("string")) == "true", 1.0).when(F.col(col).isNotNull(), 0.0)
        numeric = True
    return df.withColumn(out or col, normalize_label(src, numeric))


# --------------------------------------------------------------------------
# LBL-3: label -> model id (scoring endpoint)
# --------------------------------------------------------------------------
def label_ids(df: DataFrame, col: str, label2id: Mapping[str, int], kind: dict | None = None,
              out: str = "y_true") -> DataFrame:
    """Raw label -> class id: numeric columns truncate, booleans are 1/0,
    strings parse as integers, else match a class name exactly, else
    case-insensitively; anything else is null (and later filtered)."""
    kind = kind or label_kind(df, col)
    c = F.col(col)
    if kind["kind"] == "numeric":
        v = as_number(F.trim(c.cast("string")))
        return df.withColumn(out, v.try_cast("int"))  # a number beyond 32 bits is no known class
    if kind["kind"] == "boolean":
        return df.withColumn(out, F.when(F.lower(c.cast("string")) == "true", 1).when(c.isNotNull(), 0))
    s = X.strip_outer_ws(c)
    exact = F.create_map(*[x for k, v in label2id.items() for x in (F.lit(k), F.lit(int(v)))])
    # First canonical name per lower-cased spelling (map order = insertion order).
    lowered: dict[str, int] = {}
    for k, v in label2id.items():
        lowered.setdefault(k.lower(), int(v))
    ci = F.create_map(*[x for k, v in lowered.items() for x in (F.lit(k), F.lit(v))])
    as_int = c.try_cast("int")
    return df.withColumn(out, F.when(c.isNull(), F.lit(None).cast("int"))
                         .otherwise(F.coalesce(as_int, exact[s], ci[F.lower(s)])))


# --------------------------------------------------------------------------
# LBL-4 ... LBL-8
# --------------------------------------------------------------------------
def build_label_map(*frames: DataFrame, col: str = "label") -> DataFrame:
    """LBL-4: sorted distinct labels over the union of the inputs -> dense ids.

    Ids come from one range sort of the distinct labels (SHP-12), so no task
    holds all of them."""
    labels = None
    for f in frames:
        part = f.select(F.col(col).cast("string").alias("label")).where(F.col("label").isNotNull())
        labels = part if labels is None else labels.unionByName(part)
    path = handoff_path(labels.sparkSession, "handoff", "label-map")
    return fresh_index(labels.distinct(), ["label"], path, "label_id")


def label_map_frame(spark: SparkSession, label2id: Mapping[str, int]) -> DataFrame:
    """A label map given as a dict, as a (local, broadcastable) DataFrame."""
    return spark.createDataFrame([(k, int(v)) for k, v in label2id.items()], "label string, label_id long")


def encode_labels(df: DataFrame, label_map: DataFrame, col: str = "label", out: str = "label_id",
                  strict: bool = True) -> DataFrame:
    """LBL-5: label -> id through the map (inner join). With
    ``strict`` an unknown label raises, like a dict lookup would."""
    lm = handoff(label_map.select(F.col("label").alias("_lbl"), F.col("label_id").alias(out)), "labels")
    if strict:
        unknown = df.join(lm, F.col(col) == F.col("_lbl"), "left_anti").select(col).limit(5).collect()
        if unknown:
            raise KeyError(f"labels not in the label map: {[r[0] for r in unknown]}")
    return df.join(lm, F.col(col) == F.col("_lbl"), "inner").drop("_lbl")


def id_to_name(df: DataFrame, id_col: str, label_map: DataFrame | None = None, out: str | None = None,
               spark: SparkSession | None = None) -> DataFrame:
    """LBL-6: class id -> class name (default map {0: legitimate, 1: phishing})."""
    if label_map is None:
        spark = spark or df.sparkSession
        label_map = label_map_frame(spark, {v: k for k, v in P.DEFAULT_ID2LABEL.items()})
    lm = handoff(label_map.select(F.col("label_id").alias("_id"), F.col("label").alias(out or f"{id_col}_name")), "labels")
    return df.join(lm, F.col(id_col) == F.col("_id"), "left").drop("_id")


def binary_label(col: Column | str, positive: str) -> Column:
    """LBL-7: 1 where the value equals ``positive``, else 0 (null too)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce((c == F.lit(positive)).cast("int"), F.lit(0))


def class_weights(df: DataFrame, col: str) -> DataFrame:
    """LBL-8: balanced weights ``total / (K * count_c)`` per class.

    The per-class counts come from a partial/final hash aggregate; the
    totals are taken over those K rows only."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return counts.select(col, "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def keep_known_labels(df: DataFrame, label_map: DataFrame, col: str = "label") -> DataFrame:
    """PRJ-8 / SHP-9: keep rows whose label is in the map (left semi join)."""
    return df.join(handoff(label_map.select(F.col("label").alias("_lbl")), "labels"), F.col(col) == F.col("_lbl"),
                   "left_semi")


def unknown_label_count(df: DataFrame, label_map: DataFrame, col: str = "label") -> DataFrame:
    """PRJ-8: number of rows that would be skipped (left anti join)."""
    return (df.join(handoff(label_map.select(F.col("label").alias("_lbl")), "labels"), F.col(col) == F.col("_lbl"),
                    "left_anti")
              .agg(F.count(F.lit(1)).alias("n_unknown")))


def valid_label_counts(df: DataFrame, id_col: str = "y_true") -> DataFrame:
    """PRJ-7: rows in, rows with a usable label."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.col(id_col)).alias("n_valid"))
