"""N-gram Jaccard join in the metric space of shingle sets.

Distance is 1 - Jaccard, a metric, so with eps = 1 - threshold two documents
link when their distance is at most eps. The join is exact:

1. *Pivots.* Linked sets of sizes m and m' share one of the first
   m - ceil(t m) + 1 shingles of each, in any fixed order of all shingles. The
   order is rarest first, from word and shingle counts over all documents, so
   these lead shingles are mostly unique. The smallest document with a lead
   shingle is its pivot; every linked pair therefore meets in a region, the
   documents that share a lead shingle with one pivot.
2. *Windows.* The sizes and the places of the shared leads bound the overlap
   of two documents of a region; documents with no possible partner leave a
   region before any text is read.
3. *Large regions* (over CELL documents) are measured against their pivot, one
   row per document. Documents within eps are linked to the pivot; any others
   link only if, by the triangle inequality, their distances to the pivot
   differ by eps at most. So the region is cut into rings of width eps, each
   ring meets itself and the next only, and pairs within the innermost ring
   are skipped. Rings are dealt into cells; pairs of cells join in parallel.
4. Within a small region or a pair of cells the join recurses: new pivots split
   the documents into Voronoi regions, documents that are at most 2 eps farther
   from another pivot than from their own are replicated to it, and small or
   undivided regions are compared outright.

Documents with equal sets are one point of the space, whatever their number.
The links returned connect exactly the documents that the full link graph
connects (pairs that are connected already are not compared again).

Defined results: words are runs of non-white-space characters after
lower-casing A-Z; a text of fewer than n words is one shingle; null or empty
texts have no shingle and link with nothing; a null id links with nothing and
has a null component; rows that repeat an id are one node (linked by what any
of them links). Shingles compare by 52-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.links import components
from mailsift.llm.tables import handoff
from mailsift.llm.words import Words, by_row, distinct, mix, row_of, signed, slices, text_column

#: Entries of each of the two frequency tables that order the shingles (a bound
#: on what is broadcast; the order, and so the result, is exact for any table).
MAX_COMMON = 1 << 16
#: Documents of a cell.
CELL = 256


_KEY = np.uint64((1 << 52) - 1)


class Sets:
    """The shingle sets of one slice: ``shingle`` (52-bit hashes) sorted and
    distinct within each row, row i at ``first[i]:first[i + 1]``; ``both``
    holds row and shingle in one number; ``cost`` orders a row's shingles."""

    def __init__(self, texts: pa.LargeStringArray, n: int, words: tuple | None = None, shingles: tuple | None = None):
        w = Words(texts, lower=True)
        at, key = w.windows(n, seed=3)
        size = np.diff(w.first)
        for k in range(1, n):  # shorter texts: the whole sequence
            rows = np.flatnonzero(size == k)
            if len(rows):
                a, h = w.windows(k, seed=4 + k)
                at = np.r_[at, w.first[rows]]
                key = np.r_[key, h[np.searchsorted(a, w.first[rows])]]
        row = w.row[at]
        both = by_row(row, key)
        self.words, self.cost = w, None
        if words is None:
            both.sort()
            both = both[distinct(both)]
        else:
            common = _find(w.hash, *words)
            cost = common[at].copy()
            span = np.minimum(n, size[row])
            for k in range(1, n):
                inside = np.flatnonzero(k < span)
                cost[inside] += common[at[inside] + k]
            order = np.argsort(both)
            new = distinct(both[order])
            order = order[new]
            both, cost = both[order], cost[order]
            self.cost = cost + 256 * _find(both & _KEY, *shingles)
        self.both, self.row, self.shingle = both, row_of(both), both & _KEY
        self.first = np.searchsorted(self.row, np.arange(w.rows + 1))
        self.size = np.diff(self.first)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each row's set (0 for the empty set)."""
        out = []
        for salt in (np.uint64(0x51), np.uint64(0xA7)):
            total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(mix(self.shingle + salt)), dtype=np.uint64)]
            out.append(signed(total[self.first[1:]] - total[self.first[:-1]]))
        return out[0], out[1]


def _find(keys: np.ndarray, table: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The table's value of each key, 0 where it has none."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, value[i], 0).astype(np.int64)


def _counts(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = Sets(text_column(part, "text"), n)
                for kind, keys in ((0, sets.words.hash), (1, sets.shingle)):
                    key, count = np.unique(keys, return_counts=True)
                    many = count > 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(many.sum(), kind, np.int32)), pa.array(signed(key[many])), pa.array(count[many])], ["kind", "key", "n"])
    return run


def _common(texts: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Frequency classes (log2 of the count) of the most frequent words and
    shingles, at most MAX_COMMON of each, counted over all documents (a slice
    leaves out what it holds once)."""
    counts = handoff(texts.mapInArrow(_counts(n), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n >= 8"), "common")
    out = []
    for kind in (0, 1):
        rows = counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "key").limit(MAX_COMMON).select("key", "n").toPandas()
        key = rows["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        out.append((key[order], np.log2(rows["n"].to_numpy(np.float64))[order].astype(np.int64)))
    return out


def _leads(n: int, percent: int, words: tuple, shingles: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = Sets(text_column(part, "text"), n, words, shingles)
                order = np.argsort((sets.row << 32) | sets.cost, kind="stable")  # ties: by shingle
                leads = sets.size - (percent * sets.size + 99) // 100 + (sets.size > 0)
                place = np.arange(len(order)) - sets.first[sets.row]
                kept = order[place < leads[sets.row]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(leads)].astype(np.int32)), pa.array(signed(sets.shingle[kept])))
                f1, f2 = sets.fingerprints()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets.size.astype(np.int64)), pa.array(f1), pa.array(f2), lists], ["doc_id", "n_shingles", "f1", "f2", "leads"])
    return run


def _distances(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, p = Sets(text_column(part, "text"), n), Sets(text_column(part, "pivot_text"), n)
                merged = np.sort(np.concatenate([x.both, p.both]))
                both = np.bincount(row_of(merged[~distinct(merged)]), minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("pivot"), part.column("doc_id"), pa.array(1 - both / (x.size + p.size - both)), pa.array(100 * both >= (x.size + p.size - both) * part.column("percent").to_numpy())],
                                                 ["pivot", "doc_id", "distance", "near"])
    return run


def _possible(size: np.ndarray, place: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of others may share enough with i: at most the smaller set, less
    what precedes the first shared lead, and 100 x >= percent (m + m' - x)."""
    most = np.minimum(size[i] - place[i], size[others] - place[others])
    return (100 + percent) * most >= percent * (size[i] + size[others])


def _partnered(percent: int) -> Callable:
    """The documents of a small region that have a possible partner. With the
    leads at hand: of the document whose leads end first, a lead that is not
    shared is missing in the other set, so a linked pair shares at least
    overlap - ceil(t max(m, m')) + 1 leads."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size, place = table.column("n_shingles").to_numpy(), table.column("place").to_numpy()
        everyone = np.arange(len(size))
        shared = None
        if "leads" in table.column_names:
            lists = table.column("leads").combine_chunks()
            _, index = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            starts = np.r_[0, ends[:-1]]
            mark = np.zeros(len(index), np.int64)
        some = np.zeros(len(size), bool)
        for i in everyone.tolist():
            may = _possible(size, place, i, everyone, percent)
            if "leads" in table.column_names:
                mark[index[starts[i]: ends[i]]] = 1
                shared = np.add.reduceat(mark[index], starts)
                mark[index[starts[i]: ends[i]]] = 0
                need = -(-percent * (size[i] + size) // (100 + percent)) + (-percent * np.maximum(size[i], size) // 100) + 1
                may &= shared >= need
            may[i] = False
            some[i] = may.any()
        return table.filter(pa.array(some)).select(["pivot", "doc_id", "n_shingles", "place"])
    return run


class _Region:
    """Exact join of a bounded group of documents by recursive pivots."""

    SMALL = 24

    def __init__(self, sets: Sets, percent: int, apart: Callable[[int, np.ndarray], np.ndarray]):
        self.sets, self.percent, self.eps = sets, percent, 1 - percent / 100 + 1e-9
        values, self.index = np.unique(sets.shingle, return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.parent = np.arange(len(sets.size))
        self.links: list[tuple[int, int]] = []
        self.apart = apart  # which of some documents may link with a document, as far as known before

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def measure(self, i: int, others: np.ndarray) -> np.ndarray:
        """Distances from i to others; links are noted."""
        s = self.sets
        own = self.index[s.first[i]: s.first[i + 1]]
        self.mark[own] = True
        size = s.size[others]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(s.first[others] - (ends - size), size)
        both = np.add.reduceat(self.mark[self.index[flat]].astype(np.int64), ends - size)
        self.mark[own] = False
        either = s.size[i] + size - both
        for j in others[100 * both >= self.percent * either].tolist():
            a, b = self._root(i), self._root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((i, j))
        return 1 - both / either

    def outright(self, members: np.ndarray) -> None:
        for k, i in enumerate(members[:-1].tolist()):
            others = members[k + 1:]
            low, high = np.minimum(self.sets.size[others], self.sets.size[i]), np.maximum(self.sets.size[others], self.sets.size[i])
            others = others[(100 * low >= self.percent * high) & self.apart(i, others)]
            mine = self._root(i)
            others = others[np.fromiter((self._root(j) != mine for j in others.tolist()), bool, len(others))]
            if len(others):
                self.measure(i, others)

    def join(self, members: np.ndarray) -> None:
        if len(members) <= self.SMALL:
            return self.outright(members)
        pivots = members[:: max(1, len(members) // 4)][:4]
        d = np.stack([self.measure(int(p), members) for p in pivots])
        home = d.argmin(0)
        near = d[home, np.arange(len(members))]
        parts = [members[d[k] <= near + 2 * self.eps] for k in range(len(pivots)) if (home == k).any()]
        if max(map(len, parts)) > 0.7 * len(members):
            return self.outright(members)
        for part in parts:
            self.join(part)


def _cell_links(n: int, percent: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        sets = Sets(text_column(batch, "text"), n)
        side, place = batch.column("side").to_numpy(), batch.column("place").to_numpy()
        ring = batch.column("distance").to_numpy(zero_copy_only=False)  # nan in a small region
        eps = 1 - percent / 100 + 1e-9
        two = bool((side == 1).any())

        def apart(i: int, others: np.ndarray) -> np.ndarray:
            may = _possible(sets.size, place, i, others, percent) & ~(np.abs(ring[others] - ring[i]) > eps)
            may &= ~((ring[others] <= eps - 2e-9) & (ring[i] <= eps - 2e-9))  # both are linked to the pivot
            return may & (side[others] != side[i]) if two else may

        region = _Region(sets, percent, apart)
        region.join(np.arange(batch.num_rows))
        ids = batch.column("doc_id").to_numpy()
        found = np.array(region.links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[found[:, 0]], pa.int64()), "b": pa.array(ids[found[:, 1]], pa.int64())})
    return run


def _cells(large: DataFrame, percent: int) -> DataFrame:
    """Members (pivot, doc_id, place, distance) of large regions, one row for
    each pair of cells (ring, cell, ring2, cell2) that they take part in."""
    ringed = large.withColumn("ring", F.floor(F.col("distance") / ((100 - percent) / 100)).cast("int"))
    deals = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / CELL).cast("int").alias("deals"))
    celled = ringed.join(deals, ["pivot", "ring"]).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("deals")).cast("int")).drop("deals")
    cells = deals.select("pivot", "ring", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("cell"))
    other = cells.select("pivot", F.col("ring").alias("ring2"), F.col("cell").alias("cell2"))
    meets = cells.join(other, "pivot").where("(ring2 = ring AND cell2 >= cell AND ring > 0) OR ring2 = ring + 1")
    first = celled.join(meets, ["pivot", "ring", "cell"]).withColumn("side", F.lit(0))
    second = (celled.withColumnsRenamed({"ring": "ring2", "cell": "cell2"})
              .join(meets.where("ring <> ring2 OR cell <> cell2"), ["pivot", "ring2", "cell2"]).withColumn("side", F.lit(1)))
    return first.unionByName(second)


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sizes, links) of ``docs`` (doc_id long, text string): one row per row
    of docs (doc_id, n_shingles), and links (a, b) whose graph has the
    components of the full join at Jaccard >= percent / 100."""
    texts = docs.select("doc_id", "text")
    known = texts.where("doc_id IS NOT NULL")
    words, shingles = _common(known, n)
    leads = handoff(texts.mapInArrow(_leads(n, percent, words, shingles), "doc_id long, n_shingles long, f1 long, f2 long, leads array<long>"), "leads")
    full = leads.where("doc_id IS NOT NULL AND n_shingles > 0")
    points = full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("point"))
    same = handoff(full.select("doc_id", "f1", "f2", "n_shingles").join(points, ["f1", "f2", "n_shingles"]).where("doc_id <> point").select("doc_id", "point").distinct(), "same")
    several = full.groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high").select("doc_id")  # an id with unequal texts stays
    entries = full.select("doc_id", "n_shingles", F.posexplode("leads").alias("place", "lead"))
    pivots = entries.groupBy("lead").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("lead", "pivot")
    members = handoff(entries.join(pivots, "lead").groupBy("pivot", "doc_id", "n_shingles").agg(F.min("place").alias("place"))
                      .join(same.join(several, "doc_id", "left_anti"), "doc_id", "left_anti"), "members")
    sized = members.groupBy("pivot").agg(F.count("*").alias("members")).where("members > 1")
    member_type = "pivot long, doc_id long, n_shingles long, place int"
    small = members.join(sized.where(F.col("members") <= CELL), "pivot").select("pivot", "doc_id", "n_shingles", "place").groupBy("pivot").applyInArrow(_partnered(percent), member_type)
    large = members.join(sized.where(F.col("members") > CELL), "pivot").select("pivot", "doc_id", "n_shingles", "place")
    small = handoff(small, "small").join(full.select("doc_id", "n_shingles", "leads").hint("merge"), ["doc_id", "n_shingles"]).groupBy("pivot").applyInArrow(_partnered(percent), member_type)
    small, large = handoff(small, "small"), handoff(large, "large")
    wanted = small.select("doc_id").unionByName(large.select("doc_id")).distinct()
    read = handoff(known.hint("merge").join(wanted, "doc_id"), "texts")  # one plan at every size
    pivot_texts = read.select(F.col("doc_id").alias("pivot"), F.col("text").alias("pivot_text"))
    measured = handoff(large.select("pivot", "doc_id").join(read, "doc_id").join(pivot_texts, "pivot").withColumn("percent", F.lit(percent))
                       .mapInArrow(_distances(n), "pivot long, doc_id long, distance double, near boolean"), "measured")
    direct = measured.where("near AND pivot <> doc_id").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    cells = _cells(large.join(measured.select("pivot", "doc_id", "distance"), ["pivot", "doc_id"]), percent)
    whole = small.select("pivot", "doc_id", "place", F.lit(float("nan")).alias("distance"), *(F.lit(0).alias(c) for c in ("ring", "cell", "ring2", "cell2", "side")))
    compared = whole.unionByName(cells.drop("n_shingles")).join(read, "doc_id").groupBy("pivot", "ring", "cell", "ring2", "cell2").applyInArrow(_cell_links(n, percent), "a long, b long")
    links = same.select(F.col("point").alias("a"), F.col("doc_id").alias("b")).unionByName(direct).unionByName(compared)
    return leads.select("doc_id", "n_shingles"), links


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (the
    smallest doc_id that links reach, itself included)."""
    sizes, links = join(docs, n, percent)
    found = components(links)
    return (sizes.join(found.withColumnsRenamed({"node": "doc_id", "root": "component_id"}), "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id")).select("doc_id", "n_shingles", "component_id"))
