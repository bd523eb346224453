"""Prefix trie of conversations by whole-sequence collapse.

1. *Places.* Turns get a dense place in the order (conversation, turn, role,
   text) by one range sort; only a 128-bit digest of a turn and its word count
   move. A conversation with most of all rows is spread over many tasks.
2. *Prefix keys.* A prefix is named by its depth and the exclusive or of two
   64-bit hashes of (position, turn digest) over its turns. Running values are
   taken in blocks of BLOCK consecutive turns and carried over from the totals of
   a conversation's earlier blocks, so no window holds a whole conversation.
3. *Collapse.* Conversations with one key for their whole sequence are one
   weighted sequence (weight, smallest id, list of ends). What follows reads the
   turns of one representative a sequence.
4. *Leaves* are the sequences that are no proper prefix of another (anti-join).
5. *Weighted prefixes.* Each prefix of a representative is one row; a node is an
   aggregate of its rows. Every node belongs to its smallest member's sequence,
   so the distinct words below a node are sums of its sequences' own words and the
   tree is never walked: the tokens that sharing a prefix saves in a subtree are
   (words of all members from this depth on) - (words of its distinct nodes).

The list of ends of a sequence is hashed as text: pieces of at most PIECE
consecutive ids are joined in parallel, and one pass over the pieces of a
sequence, in order, feeds the hash without holding them.

Rebuilding: ``heads`` maps a conversation to the one whose first turns it starts
with and to their number; by default nothing is rebuilt.

Defined results: null role or text is an empty one; a null turn comes first;
turns of one number follow each other by the digest of role and text; equal
rows all count; rows without a conversation id belong to no conversation and are
left out; an empty table has no node, not even a root. Prefixes compare by
128-bit keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.tables import drop_handoff, handoff
from mailsift.operators.shape import fresh_index
from mailsift.session import handoff_path

BLOCK = 1 << 14
PIECE = 1 << 14
HEAD = 3


def turn_digest(role: Column, text: Column) -> Column:
    """Names a turn: the length of its role, its role and its text."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def _keys(position: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), position, digest).alias(f"z{salt}") for salt in (1, 2)]


def rebuilt(conversations: DataFrame, base: Column | None = None, shared: Column | None = None) -> DataFrame:
    """(c, d, x1, x2, z1, z2, words, upto) for every prefix of d >= 0 turns of
    every rebuilt conversation c: its key, its last turn's share of it, the words
    of its last turn and those of all.

    ``base`` and ``shared`` are columns over conv_id: c is rebuilt from the first
    ``shared`` (at most HEAD) turns of conversation ``base`` and its own turns after
    the first ``shared``; by default c is as it stands."""
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", turn_digest(role, text).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long").alias("words"))
    placed = fresh_index(rows, ["c", "turn", "digest"], handoff_path(spark, "llm", "turns"), out="at")
    convs = placed.groupBy("c").agg(F.min("at").alias("first"))
    id_of = lambda column: F.lit(0) if column is None else column
    convs = handoff(convs.withColumnRenamed("c", "conv_id").select(
        F.col("conv_id").alias("c"), "first", F.coalesce(id_of(base), F.col("conv_id")).cast("long").alias("base"),
        F.least(F.lit(HEAD), F.coalesce(id_of(shared), F.lit(0))).cast("long").alias("h")), "convs")
    own = placed.join(convs, "c").withColumn("p", F.col("at") - F.col("first") + 1)

    # The first turns of the bases: at most HEAD rows a conversation.
    tops = own.where(F.col("p") <= HEAD).select(F.col("c").alias("base"), F.col("p").alias("d"), "digest", "words")
    heads = handoff(convs.join(tops, "base").where("d <= h").select("c", "d", "words", *_keys(F.col("d"), F.col("digest"))), "heads")
    so_far = Window.partitionBy("c").orderBy("d")
    heads_run = heads.select("c", "d", F.bit_xor("z1").over(so_far).alias("x1"), F.bit_xor("z2").over(so_far).alias("x2"), "z1", "z2", "words", F.sum("words").over(so_far).alias("upto"))
    given = heads.groupBy("c").agg(F.count("*").alias("k"), F.bit_xor("z1").alias("g1"), F.bit_xor("z2").alias("g2"), F.sum("words").alias("g"))
    given = handoff(convs.join(given, "c", "left").select("c", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("k", "g1", "g2", "g"))), "given")

    # The turns after them, at positions counted from there.
    tails = own.where("p > h").join(given, "c").withColumn("d", F.col("k") + F.col("p") - F.col("h"))
    tails = handoff(tails.select("c", "d", "at", F.expr(f"at div {BLOCK}").alias("block"), "words", "g1", "g2", "g", *_keys(F.col("d"), F.col("digest"))), "tails")
    totals = tails.groupBy("c", "block").agg(F.bit_xor("z1").alias("t1"), F.bit_xor("z2").alias("t2"), F.sum("words").alias("t"))
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("c", "block", *(F.coalesce(agg.over(earlier), F.lit(0)).alias(name) for agg, name in
                                            ((F.bit_xor("t1"), "e1"), (F.bit_xor("t2"), "e2"), (F.sum("t"), "e"))))
    within = Window.partitionBy("c", "block").orderBy("at")
    run = tails.join(carried, ["c", "block"])
    xor = lambda x, *others: x if not others else xor(x.bitwiseXOR(others[0]), *others[1:])
    tails_run = run.select("c", "d", xor(F.bit_xor("z1").over(within), F.col("e1"), F.col("g1")).alias("x1"),
                           xor(F.bit_xor("z2").over(within), F.col("e2"), F.col("g2")).alias("x2"),
                           "z1", "z2", "words", (F.sum("words").over(within) + F.col("e") + F.col("g")).alias("upto"))
    zero = F.lit(0).cast("long")
    roots = convs.select("c", *(zero.alias(name) for name in ("d", "x1", "x2", "z1", "z2", "words", "upto")))
    return roots.unionByName(heads_run).unionByName(tails_run)


def trie(prefixes: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rebuilt`` prefixes: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    key = ["d", "x1", "x2"]
    prefixes = handoff(prefixes, "prefixes")
    whole = handoff(prefixes.groupBy("c").agg(F.max(F.struct("d", "x1", "x2", "upto")).alias("s")).select("c", "s.*"), "whole")
    sequences = handoff(whole.groupBy(*key).agg(F.min("c").alias("c"), F.count("*").alias("weight"), F.max("upto").alias("total")), "sequences")
    of_each = sequences.select("c", F.col("d").alias("length"), "weight", "total")
    ours = handoff(prefixes.join(of_each, "c"), "ours")
    drop_handoff(prefixes)

    proper = ours.where("d < length").select(*key).distinct()
    leaves = sequences.join(proper, key, "left_anti").select("c", F.lit(1).cast("long").alias("leaf"))
    owned = ours.groupBy(*key).agg(F.min("c").alias("c"), F.max("words").alias("words")).groupBy("c").agg(F.sum("words").alias("owned"))
    info = sequences.select("c").join(owned, "c", "left").join(leaves, "c", "left")
    info = handoff(info.select("c", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "info")

    nodes = ours.join(info, "c").groupBy(*key).agg(
        F.min(F.struct("c", "owned", "total")).alias("least"), F.max("z1").alias("z1"), F.max("z2").alias("z2"),
        F.max(F.col("upto") - F.col("words")).alias("before"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("total")).alias("all_words"), F.sum("owned").alias("owned"))
    # Of the smallest member's sequence, all words from here on are distinct nodes of this subtree; of each other one, what it owns.
    distinct = F.col("owned") - F.col("least.owned") + F.col("least.total") - F.col("before")
    nodes = handoff(nodes.select(
        *key, F.col("least.c").alias("conv_id"), (F.col("d") - 1).alias("pd"), F.col("x1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("z2")).alias("p2"),
        "n_convs", "n_leaves", (F.col("all_words") - F.col("n_convs") * F.col("before") - distinct).alias("saved_tokens")), "nodes")

    above = ["pd", "p1", "p2"]
    children = nodes.where("d > 0").groupBy(*(F.col(a).alias(k) for a, k in zip(above, key))).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*(F.col(k).alias(a) for a, k in zip(above, key)), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, key, "left").join(ends(whole, key), key, "left").join(parents, above, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def ends(whole: DataFrame, key: list[str]) -> DataFrame:
    """Of each sequence the SHA-256 of its conversations' ids, ascending and
    comma-joined. Ids are ranked by one range sort, joined to texts of at most
    PIECE ids, and the texts of a sequence stream through one hash."""
    path = handoff_path(whole.sparkSession, "llm", "ends")
    ranked = fresh_index(whole.select(*key, "c"), [*key, "c"], path, out="at")
    ids = F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string"))
    pieces = ranked.groupBy(*key, F.expr(f"at div {PIECE}").alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "piece")
    return pieces.mapInArrow(_hashed, ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal keys; a run may go on over batches."""
    now, state, names = None, None, []

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done) if done else ([] for _ in range(len(names) + 1))
        kinds = [pa.int64()] * len(names) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*names, "ends_sha256"])

    for batch in batches:
        names, done = batch.schema.names[:-2], []
        for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(len(names))), batch.column(len(names) + 1).to_pylist()):
            if key == now:
                state.update(b"," + ids.encode())
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
        yield rows(done)
    if now is not None:
        yield rows([(*now, state.hexdigest())])
