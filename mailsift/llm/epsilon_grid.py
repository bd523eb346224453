"""Cosine near-duplicates of vectors by an epsilon grid order join.

On unit vectors cosine >= c is a Euclidean distance of at most
eps = sqrt(2 - 2 c). The vectors are rotated to their principal axes (the
covariance is summed over all of them), which keeps distances. The grid has
cells of side eps on the leading axes; sorting by cell gives the epsilon grid
order, cut into blocks of consecutive vectors. Two blocks meet only if their
first cells allow it (a join on the first axis' cells, own and next); within a
pair of blocks the join recurses on the halves of both sequence intervals and
drops intervals whose bounding boxes on the leading axes, or balls in all
dimensions, are provably farther apart than eps. Between two small intervals a
pair is dropped where the product on the leading half of the axes and the lengths
of the rests (Cauchy-Schwarz) keep its cosine below the limit.

Pairs are never emitted: a pair of blocks returns each vector's number of
links and a spanning forest of the links found. Equal vectors are one point
with a weight. Cosines are computed in double precision from the vectors as
given.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing; vectors of different lengths never
link; rows that repeat an id are vectors of their own with this id (each row
is returned with its own number of links, and linked as one node); null ids
are returned without a component and count as links of others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.links import components
from mailsift.llm.tables import handoff

AXES = 6
#: Vectors of a block, and the bytes they may take: each pair of blocks that may meet
#: ships both, so what is shipped falls as blocks grow.
BLOCK = 16_384
BLOCK_BYTES = 8 << 20
LEAF = 256
#: Slack of the geometric bounds for rounding; links are decided on exact cosines.
SLACK = 1e-6
#: The same for products in single precision of parts of unit vectors.
FLOAT_SLACK = 1e-4


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    values = batch.column(name)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors at length one; null where they link with nothing. Each is divided by
    its largest component first, so that squares neither overflow nor vanish."""
    for batch in batches:
        given = batch.column("v")
        lengths = given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = given.flatten().to_numpy(zero_copy_only=False)
        held = np.flatnonzero(lengths)
        sound = np.zeros(len(lengths), bool)
        if len(held):
            starts = np.cumsum(lengths[held]) - lengths[held]
            with np.errstate(invalid="ignore", divide="ignore"):
                top = np.maximum.reduceat(np.abs(flat), starts)
                flat = flat / np.repeat(top, lengths[held])
                flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), lengths[held])
            # A component that is null (read as NaN) or not finite makes top so.
            sound[held] = np.isfinite(top) & (top > 0)
            flat = flat[np.repeat(sound[held], lengths[held])]
        offsets = np.r_[0, np.cumsum(np.where(sound, lengths, 0))].astype(np.int32)
        units = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()), mask=pa.array(~sound))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), units], ["vec_id", "v"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            outer = (x.T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(0).tolist()], pa.list_(pa.float64())), pa.array([outer.tolist()], pa.list_(pa.float64()))], ["d", "n", "s", "m"])


def _axes(points: DataFrame, d: int) -> np.ndarray:
    """Principal axes as rows: d x d sums over all points of dimension d."""
    sums = points.where(F.size("v") == d).select("v").mapInArrow(_moments, "d int, n long, s array<double>, m array<double>")
    total = sums.select("n", F.posexplode(F.concat("s", "m")).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("k").toPandas()
    n, x = int(total["n"].iloc[0]), total["x"].to_numpy()
    mean = x[:d] / n
    _, vectors = np.linalg.eigh(x[d:].reshape(d, d) / n - np.outer(mean, mean))
    return np.ascontiguousarray(vectors.T[::-1])


def _cells(axes: np.ndarray, eps: float) -> Callable:
    """point, v -> the rotated vector and its cells on the leading axes."""
    lead = min(AXES, len(axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = _matrix(batch) @ axes[:lead].T
                cells = np.floor(turned / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("weight"), batch.column("v"), pa.array(list(turned), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))],
                                                 ["point", "weight", "v", "lead", "cells"])
    return run


class _Join:
    """Recursive join of two sequence intervals (or one with itself)."""

    def __init__(self, v: np.ndarray, turned: np.ndarray, weight: np.ndarray, cosine: float, eps: float):
        self.v, self.lead, self.weight, self.cosine, self.eps = v, turned[:, :AXES], weight, cosine, eps + SLACK
        # x . y <= the product on the leading half of the axes + the product of the rests' lengths.
        half = max(1, turned.shape[1] // 2)
        rest = np.sqrt((turned[:, half:] ** 2).sum(1))
        self.bound = np.ascontiguousarray(np.c_[turned[:, :half], rest], dtype=np.float32)
        self.links = np.zeros(len(v), np.int64)
        self.label = np.arange(len(v))
        self.forest: list[tuple[int, int]] = []
        self.shapes: dict[tuple[int, int], tuple] = {}

    def _shape(self, s: slice) -> tuple:
        """Box on the leading axes, centre and radius of an interval, computed once."""
        key = (s.start, s.stop)
        if key not in self.shapes:
            x, v = self.lead[s], self.v[s]
            centre = v.mean(0)
            self.shapes[key] = (x.min(0), x.max(0), centre, float(np.sqrt(((v - centre) ** 2).sum(1).max())))
        return self.shapes[key]

    def _far(self, a: slice, b: slice) -> bool:
        (low_a, high_a, centre_a, radius_a), (low_b, high_b, centre_b, radius_b) = self._shape(a), self._shape(b)
        gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
        if gap @ gap > self.eps ** 2:
            return True
        apart = centre_a - centre_b
        return float(np.sqrt(apart @ apart)) - radius_a - radius_b > self.eps

    def run(self, a: slice, b: slice) -> None:
        same = a == b
        if not same and self._far(a, b):
            return
        na, nb = a.stop - a.start, b.stop - b.start
        if max(na, nb) <= LEAF:
            return self._leaf(a, b, same)
        halves = lambda s: (slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop)) if s.stop - s.start > LEAF else (s,)
        for i, x in enumerate(halves(a)):
            for j, y in enumerate(halves(b)):
                if not same or j >= i:
                    self.run(x, y)

    def _near(self, a: slice, b: slice) -> np.ndarray | None:
        """Which pairs are linked: exact cosines of those that the bound leaves."""
        near = self.bound[a] @ self.bound[b].T >= self.cosine - FLOAT_SLACK
        left = int(near.sum())
        if not left:
            return None
        if left * 20 > near.size:
            return self.v[a] @ self.v[b].T >= self.cosine
        i, j = np.nonzero(near)
        near[i, j] = np.einsum("ij,ij->i", self.v[a][i], self.v[b][j]) >= self.cosine
        return near

    def _leaf(self, a: slice, b: slice, same: bool) -> None:
        near = self._near(a, b)
        if near is None:
            return
        if same:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links[a] += near @ self.weight[b]
        if not same:
            self.links[b] += near.T @ self.weight[a]
        # Rows with a link between two trees; a row's partners are joined at once.
        crossing = near & (self.label[a][:, None] != self.label[b][None, :])
        for row in np.flatnonzero(crossing.any(1)):
            i, partners = a.start + int(row), b.start + np.flatnonzero(near[row])
            trees, first = np.unique(self.label[partners], return_index=True)
            own = self.label[i]
            others = trees != own
            if others.any():
                self.forest.extend((i, int(j)) for j in partners[first[others]])
                self.label[np.isin(self.label, np.r_[trees, own])] = min(int(own), int(trees.min()))


def _block_links(cosine: float, eps: float, axes: np.ndarray) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        v, side, point = _matrix(batch), batch.column("side").to_numpy(), batch.column("point").to_numpy()
        turned = v @ axes.T
        # Each side in epsilon grid order.
        cells = np.floor(turned[:, :AXES] / eps)
        order = np.lexsort((point, *cells.T[::-1], side))
        join = _Join(v[order], turned[order], batch.column("weight").to_numpy()[order], cosine, eps)
        point, first = point[order], int((side == 0).sum())
        left = slice(0, first)
        join.run(left, slice(first, len(side)) if first < len(side) else left)
        forest = np.array(join.forest, np.int64).reshape(-1, 2)
        some = np.flatnonzero(join.links)
        return pa.table({"a": pa.array(np.r_[point[some], point[forest[:, 0]]], pa.int64()), "b": pa.array(np.r_[np.zeros(len(some), np.int64), point[forest[:, 1]]], pa.int64(), mask=np.r_[np.ones(len(some), bool), np.zeros(len(forest), bool)]),
                         "n": pa.array(np.r_[join.links[some], np.zeros(len(forest), np.int64)], pa.int64())})
    return run


def groups(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per row of ``vectors`` (vec_id long, embedding array of numbers):
    vec_id, n_links, component_id."""
    eps = float(np.sqrt(2 - 2 * cosine))
    given = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scaled = given.mapInArrow(_unit, T.StructType([given.schema["vec_id"], given.schema["v"]]))
    rows = handoff(scaled.withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("key2", F.when(F.col("v").isNotNull(), F.hash("v"))), "vectors")
    # One point per distinct vector; its number is its smallest id (row count as weight).
    points = handoff(rows.where("v IS NOT NULL").groupBy("key", "key2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
                     .withColumn("point", F.xxhash64("key", "key2")).select("point", "key", "key2", "least", "weight", "v"), "points")
    found = None
    for d in [r["d"] for r in points.select(F.size("v").alias("d")).distinct().collect()]:
        part = _links(points.where(F.size("v") == d), d, cosine, eps)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = handoff(found, "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("others"))
    numbered = rows.join(points.select("point", "key", "key2", "least", "weight"), ["key", "key2"], "left").join(counts, "point", "left").drop("v")
    numbered = handoff(numbered.withColumn("n_links", F.when(F.col("point").isNull(), 0).otherwise(F.col("weight") - 1 + F.coalesce("others", F.lit(0))).cast("long")), "numbered")
    names = points.select("point", "least")
    forest = found.where("b IS NOT NULL").select("a", "b")
    linked = forest.join(names.withColumnsRenamed({"point": "a", "least": "ia"}), "a").join(names.withColumnsRenamed({"point": "b", "least": "ib"}), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    copies = numbered.where("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    roots = components(linked.unionByName(copies)).withColumnsRenamed({"node": "vec_id", "root": "component_id"})
    return numbered.join(roots, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))


def _links(points: DataFrame, d: int, cosine: float, eps: float) -> DataFrame:
    axes = _axes(points, d)
    gridded = handoff(points.select("point", "weight", "v").mapInArrow(_cells(axes, eps), "point long, weight long, v array<double>, lead array<double>, cells array<int>"), "grid")
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * d)))
    # Epsilon grid order: blocks are slices of it within one cell of the first axis.
    order = F.array_join(F.transform("cells", lambda c: F.lpad(F.conv(c + F.lit(1 << 20), 10, 16), 6, "0")), "")
    keyed = gridded.withColumn("cell", F.element_at("cells", 1)).withColumn("order", order)
    from pyspark.sql import Window

    sizes = keyed.groupBy("cell", "order").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("cell").orderBy("order")
    sizes = sizes.select("cell", "order", (F.sum("c").over(upto) - F.col("c")).alias("before"), F.ceil(F.col("c") / size).alias("salts"))
    placed = keyed.join(sizes, ["cell", "order"])
    # A cell with more than a block of vectors is dealt to several by hash.
    block = F.col("before").cast("long") / size
    placed = handoff(placed.select("point", "weight", "v", "lead", "cell",
                                   F.floor(block).alias("block"), F.when(F.col("salts") > 1, F.pmod(F.xxhash64("point"), F.col("salts"))).otherwise(-1).alias("salt")), "blocks")
    blocks = placed.groupBy("cell", "block", "salt").agg(*(F.min(F.element_at("lead", k + 1)).alias(f"lo{k}") for k in range(min(AXES, d))), *(F.max(F.element_at("lead", k + 1)).alias(f"hi{k}") for k in range(min(AXES, d))))
    other = blocks.select(*(F.col(c).alias(f"o_{c}") for c in blocks.columns))
    gap = [F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"o_hi{k}"), F.col(f"o_lo{k}") - F.col(f"hi{k}")) for k in range(min(AXES, d))]
    near = sum((g * g for g in gap), F.lit(0.0)) <= (eps + SLACK) ** 2
    ordered = "cell < o_cell OR block < o_block OR (block = o_block AND salt <= o_salt)"
    meets = (blocks.withColumn("o_cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1))).join(other, "o_cell")
             .where(ordered).where(near).select("cell", "block", "salt", "o_cell", "o_block", "o_salt"))
    pair = ["cell", "block", "salt", "o_cell", "o_block", "o_salt"]
    rows = placed.select("point", "weight", "v", "cell", "block", "salt")
    first = rows.join(meets, ["cell", "block", "salt"]).withColumn("side", F.lit(0))
    second = (rows.withColumnsRenamed({"cell": "o_cell", "block": "o_block", "salt": "o_salt"})
              .join(meets.where("NOT (cell = o_cell AND block = o_block AND salt = o_salt)"), ["o_cell", "o_block", "o_salt"]).withColumn("side", F.lit(1)))
    return first.unionByName(second).groupBy(*pair).applyInArrow(_block_links(cosine, eps, axes), "a long, b long, n long")
