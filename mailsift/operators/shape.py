"""Row-set shaping: union, first-wins dedup, seeded balance and splits,
set differences, seeded shuffle (SHP-1 ... SHP-13).

Seeded selection never ranks a whole class in one task. Rows are ordered by
``md5(seed|key)``; hex digits of that hash give buckets, so a class spreads
over many buckets. Per-(class, bucket) counts and their running sums decide
every bucket that lies entirely inside one segment; buckets that straddle a
cut point are refined on the next digits, and only the rows left in straddling
sub-buckets are ranked row by row (SURVEY H3). All of that works on a written
table of keys and classes; the rows themselves are read once more at the end.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.session import handoff, handoff_path, shared_scratch

# Hex digits of the seeded hash in one level of buckets (65,536 a class).
DIGITS = 4


def union_tables(frames: Sequence[DataFrame], tag: str | None = "_file_ord") -> DataFrame:
    """SHP-1 / SRC-4: union by column name (missing columns -> null), each
    input tagged with its position so input order survives."""
    out = None
    for i, f in enumerate(frames):
        g = f.withColumn(tag, F.lit(i)) if tag else f
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out


def drop_duplicates_first(df: DataFrame, subset: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SHP-2: drop duplicates on ``subset`` keeping the first row in input
    ``order`` (unique per row). Only a hash of the key and the order columns
    are aggregated, pre-combined before the shuffle; the winning rows are then
    picked by a semi join, so no text is sorted or used as a shuffle key."""
    hashed = df.withColumn("_key", F.sha2(F.to_json(F.struct(*subset)), 256))
    first = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    winners = hashed.groupBy("_key").agg(first.alias("_first"))
    own = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    kept = hashed.withColumn("_own", own).join(winners.select(F.col("_key").alias("_k"), "_first"),
                                               (F.col("_key") == F.col("_k")) & F.col("_own").eqNullSafe(F.col("_first")), "left_semi")
    return kept.select(*subset, *[c for c in df.columns if c not in subset])


def seed_hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _group_name(by: str) -> Column:
    """A class as text; null is a class of its own."""
    return F.coalesce(F.concat(F.lit("v"), F.col(by).cast("string")), F.lit("null"))


def _cut_table(df: DataFrame, by: str | None, cuts: Mapping[object, Sequence[int]] | DataFrame) -> DataFrame:
    """(_g, _cuts) from a mapping or from a frame (``by``, cuts)."""
    if isinstance(cuts, DataFrame):
        return cuts.select(_group_name(by).alias("_g"), F.col("cuts").alias("_cuts"))
    spark, rows = df.sparkSession, [(k, [int(c) for c in v]) for k, v in cuts.items()]
    if by is None:
        return spark.createDataFrame([("all", v) for _, v in rows], "_g string, _cuts array<bigint>")
    kind = df.schema[by].dataType.simpleString()
    frame = spark.createDataFrame(rows, f"`{by}` {kind}, _cuts array<bigint>")
    return frame.select(_group_name(by).alias("_g"), "_cuts")


def _n_cuts_at_or_below(cuts: Column, x: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= x))


def _keyed(df: DataFrame, by: str | None, key: str, seed: int) -> DataFrame:
    """Key, class and hash digits of every row as a written table. (Stored, the
    one class of ``by=None`` is a join key like any other.)"""
    group = _group_name(by) if by else F.lit("all")
    h = seed_hash(seed, key)
    cols = [key] + ([by] if by and by != key else [])
    return handoff(df.select(*cols, group.alias("_g"), F.substring(h, 1, DIGITS).alias("_b1"),
                             F.substring(h, DIGITS + 1, DIGITS).alias("_b2"), h.alias("_h")), "keys")


def segment_table(rows: DataFrame, by: str | None, key: str,
                  cuts: Mapping[object, Sequence[int]] | DataFrame, segment: str = "_segment") -> DataFrame:
    """(key, by, segment) of ``seeded_segments`` as a written table, from the
    rows of ``_keyed``.

    Level-1 buckets (first hash digits) carry running counts per class; the
    level-1 buckets that straddle a cut (at most one per cut) are counted again
    by the next digits; rows of the level-2 buckets that still straddle one are
    ranked exactly, about ``n / 16**8`` of a class's ``n`` rows per cut. Joins
    take whatever plan the tables' sizes allow."""
    cols = [key] + ([by] if by and by != key else [])
    cut_df = _cut_table(rows, by, cuts)
    g1, g2 = ["_g", "_b1"], ["_g", "_b1", "_b2"]
    n = F.count(F.lit(1)).alias("_n")

    def bounds(counts: DataFrame, before: Column, first: str, seg: str, cut: str) -> DataFrame:
        t = counts.withColumn(first, before - F.col("_n"))
        lo = _n_cuts_at_or_below(F.col("_cuts"), F.col(first))
        hi = _n_cuts_at_or_below(F.col("_cuts"), F.col(first) + F.col("_n") - 1)
        return t.withColumn(seg, lo).withColumn(cut, lo != hi).drop("_n")

    c1 = rows.groupBy(*g1).agg(n).join(cut_df, "_g", "left")
    c1 = c1.withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    t1 = bounds(c1, F.sum("_n").over(Window.partitionBy("_g").orderBy("_b1")), "_s1", "_seg1", "_x1")

    c2 = rows.join(t1.filter("_x1").select(*g1, "_s1", "_cuts"), g1).groupBy(*g2, "_s1", "_cuts").agg(n)
    w2 = Window.partitionBy(*g1).orderBy("_b2")
    t2 = bounds(c2, F.col("_s1") + F.sum("_n").over(w2), "_s2", "_seg2", "_x2")

    w3 = Window.partitionBy(*g2).orderBy("_h", key)
    t3 = (rows.join(t2.filter("_x2").select(*g2, "_s2", "_cuts"), g2)
              .withColumn("_r", F.col("_s2") + F.row_number().over(w3) - 1)
              .select(F.col(key).alias("_k3"), _n_cuts_at_or_below(F.col("_cuts"), F.col("_r")).alias("_seg3")))

    out = (rows.join(t1.select(*g1, "_seg1", "_x1"), g1)
               .join(t2.select(*g2, "_seg2", "_x2"), g2, "left")
               .join(t3, F.col(key) == F.col("_k3"), "left"))
    seg = F.when(~F.col("_x1"), F.col("_seg1")).when(~F.col("_x2"), F.col("_seg2")).otherwise(F.col("_seg3"))
    return handoff(out.select(*cols, seg.alias(segment)), "segments")


def seeded_segments(df: DataFrame, by: str | None, key: str, seed: int,
                    cuts: Mapping[object, Sequence[int]] | DataFrame, segment: str = "_segment") -> DataFrame:
    """Assign each row a segment number from its exact seeded rank.

    Rows of group ``g`` are ranked 0, 1, ... by ``(md5(seed|key), key)``; a row
    with rank ``r`` gets segment ``#{c in cuts[g] : c <= r}``. Rows of groups
    without cuts get segment 0; null is a group. ``key`` must be unique and not
    null. ``cuts`` is a mapping or, for any number of groups, a frame of ``by``
    and ``cuts``. The rows are joined once, by key, with ``segment_table``."""
    return df.join(segment_table(_keyed(df, by, key, seed), by, key, cuts, segment).select(key, segment), key)


def balance_classes(df: DataFrame, label: str, key: str, classes: Sequence = (0, 1), seed: int = 42) -> DataFrame:
    """SHP-3: down-sample the larger of two classes to the smaller one's size
    (seeded); rows of any other class are dropped."""
    two = _keyed(df.filter(F.col(label).isin(*classes)), label, key, seed)
    counts = {r[0]: r[1] for r in two.groupBy(label).count().collect()}  # one row per listed class
    n = min(counts.get(c, 0) for c in classes)
    segs = segment_table(two, label, key, {c: [n] for c in classes}, "_seg")
    return df.join(segs.filter(F.col("_seg") == 0).select(key), key)


def largest_remainder(counts: DataFrame, total: int, n_draws: int, by: str = "label", n: str = "n", out: str = "share") -> DataFrame:
    """Stratified allocation of ``n_draws`` of ``total`` rows over classes: floor
    of the proportional share, then one more row to the largest remainders (ties
    to the smaller label, null last). ``counts`` has one row per class, in any
    number; remainders are ranked by a range sort, and only a sum reaches the
    driver."""
    part = F.col(n).cast("double") / F.lit(float(total or 1)) * F.lit(float(n_draws))
    base = counts.withColumn(out, F.floor(part)).withColumn("_less", F.floor(part) - part)
    need = n_draws - (base.agg(F.sum(out)).first()[0] or 0) if total else 0
    if need <= 0:
        return base.drop("_less")
    path = handoff_path(counts.sparkSession, "handoff", "shares")
    ranked = fresh_index(base.withColumn("_none", F.col(by).isNull()), ["_less", "_none", by], path, "_rank")
    return ranked.withColumn(out, F.col(out) + (F.col("_rank") < need).cast("long")).drop("_less", "_none", "_rank")


def split_quotas(counts: DataFrame, hold_fraction: float, test_of_hold: float, by: str = "label") -> DataFrame:
    """Per-class n_train, n_val and n_test of a two-stage split, added to
    ``counts`` (``by``, n).

    Stage 1 holds out ``ceil(hold_fraction * n)`` rows; the train side is
    allocated by largest remainder and the hold-out gets the rest. Stage 2
    gives ``ceil(test_of_hold * n_hold)`` of the hold-out to test the same way.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    n_hold = math.ceil(hold_fraction * total)
    held = largest_remainder(counts, total, total - n_hold, by, "n", "n_train").withColumn("_hold", F.col("n") - F.col("n_train"))
    out = largest_remainder(held, n_hold, n_hold - math.ceil(test_of_hold * n_hold), by, "_hold", "n_val")
    return out.withColumn("n_test", F.col("_hold") - F.col("n_val")).drop("_hold")


SPLIT_NAMES = ("train", "val", "test")


def stratified_split(df: DataFrame, label: str, key: str, hold_fraction: float = 0.2, test_of_hold: float = 0.5,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """SHP-4 / SHP-5: stratified train / val / test in one pass, as a
    ``split`` column (SHP-13 keeps the parts in one table)."""
    return df.join(_split_table(df, label, key, hold_fraction, test_of_hold, seed, out), key)


def _split_table(df: DataFrame, label: str, key: str, hold_fraction: float, test_of_hold: float, seed: int, out: str) -> DataFrame:
    """(key, split) of ``stratified_split``."""
    keys = _keyed(df, label, key, seed)
    counts = handoff(keys.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "counts")
    q = split_quotas(counts, hold_fraction, test_of_hold, label)
    cuts = q.select(label, F.array("n_train", F.col("n_train") + F.col("n_val")).alias("cuts"))
    segs = segment_table(keys, label, key, cuts, "_seg")
    name = F.element_at(F.array(*[F.lit(s) for s in SPLIT_NAMES]), F.col("_seg") + 1)
    return segs.select(key, name.alias(out))


def stored_split(df: DataFrame, label: str, key: str, hold_fraction: float = 0.2, test_of_hold: float = 0.5,
                 seed: int = 42, out: str = "split") -> DataFrame:
    """SHP-4 / SHP-5 drawn once for all queries on the same rows: the (key,
    split) table of ``stratified_split`` is kept in the shared folder under the
    seed, the fractions and a fingerprint of every row's key and label.

    The fingerprint is taken anew by every call (one aggregate over two columns),
    so rows that changed in either get a split of their own; other columns
    have no part in a split. Of two calls at once each writes its own copy;
    both hold the same rows, and a copy counts once it is complete."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    sums = [F.sum(F.xxhash64(F.lit(i), key, label).cast("decimal(38,0)")) for i in range(2)]
    known = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = [df.schema[c].dataType.simpleString() for c in (key, label)]
    name = hashlib.md5(repr((tuple(known), kinds, key, hold_fraction, test_of_hold, seed, out)).encode()).hexdigest()
    folder = f"{shared_scratch(spark, 'splits')}/{name}"
    found = jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    done = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    if done:
        path = min(str(s.getPath().getParent()) for s in done)
    else:
        path = f"{folder}/{uuid.uuid4().hex}"
        _split_table(df, label, key, hold_fraction, test_of_hold, seed, out).write.parquet(path)
    return df.join(spark.read.parquet(path), key)


def split_test_then_stratified_val(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                                   val_fraction: float = 0.125, seed: int = 42, out: str = "split") -> DataFrame:
    """SHP-6: an unstratified test part first, then a stratified validation
    part of the remaining rows. Both are drawn on one table of keys; the rows
    are read twice in all."""
    keys = handoff(df.select(key, label), "classes")
    n = keys.count()
    first = segment_table(_keyed(keys, None, key, seed), None, key, {0: [n - math.ceil(test_fraction * n)]}, "_t")
    rest = _keyed(keys.join(first.filter("_t = 0").select(key), key, "left_semi"), label, key, seed + 1)
    counts = handoff(rest.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "counts")
    n_rest = n - math.ceil(test_fraction * n)
    train = largest_remainder(counts, n_rest, n_rest - math.ceil(val_fraction * n_rest), label)
    second = segment_table(rest, label, key, train.select(label, F.array("share").alias("cuts")), "_v")
    a = second.select(key, F.when(F.col("_v") == 0, "train").otherwise("val").alias(out))
    return df.join(a.unionByName(first.filter("_t = 1").select(key, F.lit("test").alias(out))), key)


def words_only_in(df: DataFrame, label: str, positive, words: str = "word") -> DataFrame:
    """SHP-7: distinct words seen with the positive label and never with any
    other (one aggregate, no join)."""
    is_pos = F.col(label) == F.lit(positive)
    return (df.groupBy(words).agg(F.max(is_pos.cast("int")).alias("_p"), F.min(is_pos.cast("int")).alias("_q"))
              .filter((F.col("_p") == 1) & (F.col("_q") == 1)).select(words))


def lookup_with_default(df: DataFrame, col: str, dim: DataFrame, dim_key: str, dim_val: str, default,
                        out: str | None = None, broadcast: bool = False) -> DataFrame:
    """SHP-8: dictionary lookup with a default = left equi-join + coalesce.
    ``broadcast`` only when the caller knows the dimension's size bound."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(dim_val).alias("_v"))
    d = F.broadcast(d) if broadcast else d
    return (df.join(d, F.col(col) == F.col("_k"), "left")
              .withColumn(out or dim_val, F.coalesce(F.col("_v"), F.lit(default))).drop("_k", "_v"))


def pair_by_key(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """SHP-10: positional pairing re-expressed as a keyed equi-join."""
    return left.join(right, key)


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, out: str = "shuffle_key") -> DataFrame:
    """SHP-11: a reproducible shuffle order (range-partitioned global sort)."""
    return df.withColumn(out, seed_hash(seed, key)).orderBy(out, key)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """SHP-13: one table, one folder per split (partition pruning on read)."""
    df.write.mode(mode).partitionBy(split).parquet(path)


# monotonically_increasing_id() = partition index << 33 | position in partition.
_POSITION_MASK = (1 << 33) - 1


def fresh_index(df: DataFrame, order: Sequence[str], path: str, out: str = "row_idx") -> DataFrame:
    """SHP-12: a fresh, contiguous 0-based row index in the total order
    ``order`` (e.g. file position then row position after a concat).

    No window over the whole table: rows are range-partitioned and sorted on
    ``order``, and each row records its partition and its position inside it.
    That is written to ``path`` (a shared folder) first, because range bounds
    are sampled and a second evaluation could cut differently. The index is
    then the row's position plus the number of rows in earlier partitions,
    from a table with one row per partition (broadcast; its size is the
    partition count)."""
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_part", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))))
    ranged.write.mode("overwrite").parquet(path)
    fixed = df.sparkSession.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (fixed.groupBy("_part").count()
               .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off")))
    return (fixed.join(F.broadcast(offsets), "_part")
                 .withColumn(out, F.col("_off") + F.col("_pos")).drop("_part", "_pos", "_off"))
