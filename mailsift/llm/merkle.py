"""Merkle manifest of a table, and proofs of many leaves by octopus multiproofs.

Rows are the leaves of one binary tree per group (``tree``), in a total order;
the groups' roots, in the order of the group values, are the leaves of one more
tree. Every two consecutive nodes become the hash of their digests as hex text,
a lone last node the hash of its own.

*Building.* Leaves get dense places by a range sort (no window over a group).
Aligned blocks of 2**K nodes are folded K levels up, each block in one task;
their roots are the next tier's nodes, so a tree of n leaves takes log(n) / K
rounds and a group with most of the rows is only many blocks.

*Proving.* The rows to prove may be any part of the leaves. Each leaf partition
(the chosen leaves of one aligned block) computes which node coordinates it can
neither hold nor derive: going up level by level, the siblings of known nodes
that are not known themselves. This minimal union is fetched by one join with
the node tables, of which only the tiers that are asked for are read. With
it the partition derives the interiors that its leaves share, once each, and
cuts every leaf's own path out of them. A partition that proves a whole block
fetches one node for each level above it.

A path lists one step a level from the leaf up: ``<`` and a digest (a sibling to
the left), ``>`` and a digest (to the right), or ``=`` (no sibling). ``fold``
recomputes a root from a claimed leaf and a path as a column expression.

Defined results: nulls in any field and in the group are values of their own
(null groups sort first); rows with equal order columns are ordered by their
digest, wholly equal rows are leaves of their own and may swap places, which no
digest shows; a group of one row has its leaf for a root; an empty table has no
leaves and no root. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.tables import drop_handoff, handoff
from mailsift.operators.shape import fresh_index
from mailsift.session import handoff_path

K = 10
_NODES = "t string, n long, level int, i long, digest string, top boolean"


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field, '-' if null, else its length in
    UTF-8 bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _parent(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


def _height(n: int) -> int:
    return (n - 1).bit_length()


def _size(n: int, level: int) -> int:
    """Nodes of a level of a tree with n leaves."""
    return -(-n >> level)


class Forest:
    """Trees over rows with columns t (tree), n (its leaves), i (place) and
    digest; ``tiers[k]`` holds the nodes of levels k * K + 1 to (k + 1) * K."""

    def __init__(self, rows: DataFrame, order: list[str]):
        """``rows``: columns t, digest and others; ``order``: columns that order a tree's leaves."""
        spark = rows.sparkSession
        indexed = fresh_index(rows, ["t", *order, "digest"], handoff_path(spark, "llm", "leaves"), out="at")
        self.sizes = handoff(indexed.groupBy("t").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees")
        self.leaves = indexed.join(self.sizes, "t").withColumn("i", F.col("at") - F.col("first")).drop("at", "first")
        most = self.sizes.agg(F.max("n")).first()[0] or 0
        self.tiers: list[DataFrame] = []
        below = self.leaves.select("t", "n", "i", "digest").where("n > 1")
        while _height(most) > K * len(self.tiers):
            low = K * len(self.tiers)
            tier = handoff(below.groupBy("t", F.shiftright("i", K).alias("block")).applyInArrow(_folded_from(low, K), _NODES), "nodes")
            self.tiers.append(tier)
            below = tier.where((F.col("level") == low + K) & ~F.col("top")).select("t", "n", "i", "digest")
        roots = [self.leaves.where("n = 1").select("t", "digest"), *(tier.where("top").select("t", "digest") for tier in self.tiers)]
        self.roots = handoff(reduce(DataFrame.unionByName, roots), "roots")

    def prove(self, chosen: DataFrame) -> DataFrame:
        """Rows of ``self.leaves`` (any part of them, all columns), each with its path."""
        block = F.shiftright("i", K).alias("block")
        wanted = handoff(chosen.groupBy("t", block).applyInArrow(_missing, "t string, block long, level int, i long"), "wanted")
        asked = {r["tier"] for r in wanted.select(F.expr(f"(level + {K - 1}) div {K} - 1").cast("int").alias("tier")).distinct().collect()}
        nodes = [self.leaves.select("t", F.lit(0).alias("level"), "i", "digest")] if -1 in asked else []
        nodes += [self.tiers[k].select("t", "level", "i", "digest") for k in sorted(asked - {-1})]
        if nodes:
            fetched = wanted.join(reduce(DataFrame.unionByName, nodes), ["t", "level", "i"])
        else:
            fetched = wanted.withColumn("digest", F.lit(None).cast("string"))
        fetched = fetched.select(*(F.col(c).alias(c) for c in ("t", "block", "level", "i", "digest")))  # columns of its own, where level 0 was read too
        schema = T.StructType([*chosen.schema.fields, T.StructField("path", T.ArrayType(T.StringType()))])
        return chosen.groupBy("t", block).cogroup(fetched.groupBy("t", "block")).applyInArrow(_paths, schema)

    def drop(self) -> None:
        """Delete the node tables (nothing that reads them can run after)."""
        for table in (self.sizes, self.roots, *self.tiers):
            drop_handoff(table)


def _folded_from(low: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    def folded(table: pa.Table) -> pa.Table:
        return _folded(table, low, levels)
    return folded


def _folded(table: pa.Table, low: int, levels: int) -> pa.Table:
    """All nodes above a whole block of a tree's level ``low``, so many levels up at most."""
    place = np.argsort(table["i"].to_numpy())
    first, n = int(table["i"][int(place[0])].as_py()), table["n"][0].as_py()
    digests = table["digest"].take(pa.array(place)).to_pylist()
    level, places, found = [], [], []
    for up in range(low + 1, min(low + levels, _height(n)) + 1):
        pairs = iter([*digests, ""] if len(digests) % 2 else digests)
        digests = [_parent(a, b) for a, b in zip(pairs, pairs)]
        first >>= 1
        level += [up] * len(digests)
        places += range(first, first + len(digests))
        found += digests
    count = len(found)
    return pa.table({"t": pa.array([table["t"][0].as_py()] * count, pa.string()), "n": pa.array([n] * count, pa.int64()), "level": pa.array(level, pa.int32()),
                     "i": pa.array(places, pa.int64()), "digest": pa.array(found, pa.string()), "top": pa.array([v == _height(n) for v in level], pa.bool_())})


def _levels(places: list[int], n: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(level, known places, places of missing siblings), from the leaves up."""
    known = places
    for level in range(_height(n)):
        held, size = set(known), _size(n, level)
        yield level, known, [s for s in (i ^ 1 for i in known) if s not in held and s < size]
        known = sorted({i >> 1 for i in known})


def _missing(key: tuple, table: pa.Table) -> pa.Table:
    """The coordinates that a leaf partition has to fetch."""
    places = sorted(table["i"].to_pylist())
    asked = [(level, i) for level, _, missing in _levels(places, table["n"][0].as_py()) for i in missing]
    return pa.table({"t": pa.array([key[0].as_py()] * len(asked), pa.string()), "block": pa.array([key[1].as_py()] * len(asked), pa.int64()),
                     "level": pa.array([a[0] for a in asked], pa.int32()), "i": pa.array([a[1] for a in asked], pa.int64())})


def _paths(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """The leaves with their paths, cut out of the shared interiors."""
    order = pa.array(np.argsort(leaves["i"].to_numpy()))
    leaves = leaves.take(order)
    n = leaves["n"][0].as_py()
    places = leaves["i"].to_pylist()
    given = {(a, b): d for a, b, d in zip(fetched["level"].to_pylist(), fetched["i"].to_pylist(), fetched["digest"].to_pylist())}
    digests = dict(zip(places, leaves["digest"].to_pylist()))
    above: list[list[str]] = [[] for _ in places]
    for level, known, missing in _levels(places, n):
        digests.update((s, given[level, s]) for s in missing)
        for at, i in enumerate(places):
            s = (i >> level) ^ 1
            above[at].append("=" if s not in digests else (">" if s & 1 else "<") + digests[s])
        digests = {p: _parent(digests[2 * p], digests.get(2 * p + 1, "")) for p in {i >> 1 for i in known}}
    return leaves.append_column("path", pa.array(above, pa.list_(pa.string())))


def fold(claimed: Column, path: Column) -> Column:
    """The root that a claimed leaf and a path lead to."""
    step = lambda digest, s: F.sha2(F.when(s == "=", digest).when(F.left(s, F.lit(1)) == "<", F.concat(F.substr(s, F.lit(2)), digest))
                                    .otherwise(F.concat(digest, F.substr(s, F.lit(2)))), 256)
    return F.aggregate(path, claimed, step)


def siblings(path: Column) -> Column:
    """The siblings' digests of a path, joined."""
    return F.array_join(F.transform(F.filter(path, lambda s: s != "="), lambda s: F.substr(s, F.lit(2))), "")


def manifest(rows: DataFrame, tree: str, order: str, digest: str, only: Column | None = None) -> tuple[Forest, Forest]:
    """The trees of the groups, and the tree over their roots. A group is named
    by ``t``: 'n' for null, else 's' and its value, which keeps the order. Leaves
    hold the input's ``row`` and whether it is ``chosen``."""
    name = F.coalesce(F.concat(F.lit("s"), F.col(tree).cast("string")), F.lit("n"))
    chosen = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    groups = Forest(rows.select(name.alias("t"), F.col(order).alias("rank"), F.col(digest).alias("digest"), chosen.alias("chosen"), F.struct("*").alias("row")), ["rank"])
    return groups, Forest(groups.roots.select(F.lit("all").alias("t"), F.col("t").alias("group"), "digest"), ["group"])


def proofs(rows: DataFrame, tree: str, order: str, digest: str, only: Column | None = None) -> DataFrame:
    """Columns of ``rows`` for the rows that ``only`` selects (default: all), with
    ``path`` (leaf to root of all), ``subroot`` and ``root``; input columns of
    these three names are replaced."""
    groups, top = manifest(rows, tree, order, digest, only)
    proven = groups.prove(groups.leaves if only is None else groups.leaves.where("chosen")).withColumnRenamed("path", "low")
    upper = top.prove(top.leaves).join(top.roots.withColumnRenamed("digest", "root"), "t")
    upper = handoff(upper.select(F.col("group").alias("t"), F.col("path").alias("high"), F.col("digest").alias("subroot"), "root"), "top")
    kept = [F.col(f"row.`{c}`") for c in rows.columns if c not in ("path", "subroot", "root")]
    return proven.join(upper, "t").select(*kept, F.concat("low", "high").alias("path"), "subroot", "root")
