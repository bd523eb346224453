"""Substring de-duplication by a lookup of word windows.

A window of ``window`` words that also occurs in a document with a smaller id is
a duplicate; runs of duplicate windows with one reference are the factors. This
replaces the greedy parse of relative Lempel-Ziv factoring, which would hide
copies that begin inside a factor.

The reference blocks are indexed in two steps, both sharded by hash:

1. *Anchors.* Of every ``window`` consecutive words the ``anchor``-word gram
   with the smallest hash is its anchor, so equal windows have equal anchors
   (about a fifth of the words start one). Anchors held by one document only
   are dropped; no window over them can have a second copy.
2. *Blocks.* The consecutive windows over one remaining anchor form a block
   entry: its window hashes, document and place. All entries of an anchor meet
   in one task, sorted by document; there each window gets the first document
   that holds it. An anchor with more than ``HOT`` places in the corpus (a common
   phrase) is no block: each window over it is one of its own, keyed by its hash,
   so equal windows meet but the phrase does not. A task keeps the distinct
   windows of the block it reads (at most those of ``HOT`` places) and no
   entries. Every window is looked up by itself, those across a factor's boundary
   too, so a greedy factor never hides a copy.

A document's factors are then the maximal runs of consecutive windows with the
same reference document. Before entries are shuffled, each slice of a few
megabytes keeps only its smallest holder of a window (the others are copies
whatever else the corpus holds), so a passage of a third of all documents
sends one entry per slice. The reference of a factor is a smaller document
that holds it; which one of several may depend on the slices.

Defined results: null text is an empty text; texts of fewer than ``window``
words keep all words; rows whose id is null neither lose words nor serve as
reference; rows that repeat an id are one document (they are no copies of each
other, and a span found in one is removed at the same place of the others if
they hold the same text). Words compare by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.words import Words, by_row, distinct, mix, row_of, signed, slices, text_column

_KEY = np.uint64((1 << 52) - 1)
WINDOW = 13
ANCHOR = 5
#: An anchor with more places than this is split by window; both give the same result.
HOT = 8192
_SPLIT = np.uint64(1 << 52)  # beside an anchor's 52 bits


def _anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, first word of its anchor, gram hashes by word)."""
    at, grams = words.windows(anchor, seed=1)
    by_word = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    by_word[at] = grams
    count = len(words.hash) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), by_word
    start = np.flatnonzero(words.row[:count] == words.row[window - 1:])
    best, least = start.copy(), by_word[start]
    for k in range(1, window - anchor + 1):
        other = by_word[start + k]
        less = other < least
        best[less] = start[less] + k
        least[less] = other[less]
    return start, best, by_word


def _anchor_rows(window: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(text_column(part, "text"))
                _, best, grams = _anchors(words, window, anchor)
                best = np.unique(best)
                both = by_row(words.row[best], grams[best])
                both.sort()
                first = np.flatnonzero(distinct(both))
                places = np.diff(np.r_[first, len(both)])
                both = both[first]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row_of(both)], pa.int64()), pa.array(signed(both & _KEY)), pa.array(places.astype(np.int32))], ["doc_id", "anchor", "places"])
    return run


def _smallest(window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document that holds each entry's window."""
    order = np.argsort(window)
    new = distinct(window[order])
    out = np.empty(len(doc), np.int64)
    if len(order):
        out[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _lists(first: np.ndarray, size: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[first, size].astype(np.int32)), values)


def _entry_rows(window: int, anchor: int) -> Callable:
    """Block entries of the windows over shared anchors. A window that a
    smaller document of the same slice holds has its reference already; an
    entry of such windows only is not looked up (any key, no hashes). Over a
    split anchor each window is an entry, keyed by its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(text_column(part, "text"))
                start, best, grams = _anchors(words, window, anchor)
                lists = part.column("anchors")
                shared = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                split = (shared & _SPLIT) != 0
                shared = (owner.astype(np.uint64) << np.uint64(52)) | shared & _KEY
                key = by_row(words.row[best], grams[best])
                hit = np.isin(key, shared)
                start, best = start[hit], best[hit]
                alone = np.isin(key[hit], shared[split])
                if not len(start):
                    continue
                at, wide = words.windows(window, seed=2)
                wide = signed(wide[np.searchsorted(at, start)])
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[words.row[start]]
                ref = _smallest(wide, doc)
                known = ref < doc
                first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1) | alone[1:]])
                done = np.logical_and.reduceat(known, first)
                pos = (start - words.first[words.row[start]])[first]
                block = np.where(done, signed(mix(wide[first].view(np.uint64) + doc[first].view(np.uint64))), np.where(alone[first], wide[first], signed(grams[best[first]])))
                sent = ~np.repeat(done, np.diff(np.r_[first, len(start)]))
                sizes = np.add.reduceat(sent.astype(np.int64), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(doc[first], pa.int64()), pa.array(pos.astype(np.int32)), _lists(first, len(start), pa.array(ref, mask=~known)),
                     _lists(np.cumsum(sizes) - sizes, int(sizes.sum()), pa.array(wide[sent]))],
                    ["block", "doc_id", "pos", "refs", "hashes"])
    return run


def _look_up(entries: pa.RecordBatch, seen: np.ndarray, holders: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """References of ``entries``, sorted by block and document, with the windows
    of the first block ``seen`` before and their documents; the windows of the
    last block and theirs."""
    hashes, refs = (entries.column(c) for c in ("hashes", "refs"))
    counts = hashes.value_lengths().to_numpy(zero_copy_only=False)
    doc, block = entries.column("doc_id").to_numpy(), entries.column("block").to_numpy()
    holder = np.r_[holders, np.repeat(doc, counts)]
    window = np.r_[seen, hashes.flatten().to_numpy(zero_copy_only=False)]
    least = _smallest(window, holder)
    flat = refs.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).copy()
    ref = flat.fill_null(0).to_numpy(zero_copy_only=False).copy()
    sizes = refs.value_lengths().to_numpy(zero_copy_only=False)
    sent = np.repeat(counts > 0, sizes)
    ref[sent] = least[len(seen):]
    known[sent] = least[len(seen):] < holder[len(seen):]
    last = np.r_[np.full(len(seen), block[0] == block[-1]), np.repeat(block == block[-1], counts)]
    seen, at = np.unique(window[last], return_index=True)
    holders = least[last][at]
    some = np.logical_or.reduceat(known, np.cumsum(sizes) - sizes)
    keep = np.repeat(some, sizes)
    sizes = sizes[some]
    out = pa.RecordBatch.from_arrays(
        [pa.array(doc[some]), pa.array(entries.column("pos").to_numpy()[some]),
         _lists(np.cumsum(sizes) - sizes, int(sizes.sum()), pa.array(ref[keep], mask=~known[keep]))], ["doc_id", "pos", "refs"])
    return out, seen, holders


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries arrive sorted by block and document, so no later entry holds a
    window's smallest document; of a block that goes on in the next batch, its
    distinct windows and their documents are kept."""
    none = np.zeros(0, np.int64)
    block, seen, holders = None, none, none
    for batch in batches:
        if batch.num_rows:
            if batch.column("block")[0].as_py() != block:
                seen, holders = none, none
            out, seen, holders = _look_up(batch, seen, holders)
            block = batch.column("block")[-1].as_py()
            yield out


def matches(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, pos, refs) of ``docs`` (doc_id, text): for consecutive windows
    from word pos on, a document with a smaller id in which the window also
    starts (null: none)."""
    texts = docs.where("doc_id IS NOT NULL")
    anchors = texts.select("doc_id", "text").mapInArrow(_anchor_rows(window, anchor), "doc_id long, anchor long, places int")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("places").alias("places")).where("n > 1")
    shared = shared.select("anchor", F.when(F.col("places") > HOT, F.col("anchor").bitwiseOR(F.lit(int(_SPLIT)))).otherwise(F.col("anchor")).alias("marked"))
    lists = anchors.select("doc_id", "anchor").join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("marked").alias("anchors"))
    entries = texts.join(lists, "doc_id").mapInArrow(_entry_rows(window, anchor), "block long, doc_id long, pos int, refs array<long>, hashes array<long>")
    return entries.repartition("block").sortWithinPartitions("block", "doc_id").mapInArrow(_looked_up, "doc_id long, pos int, refs array<long>")


def factors(pos: np.ndarray, ref: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs in one document: (first word, words, reference document)
    of each maximal run of consecutive windows with one reference."""
    if not len(pos):
        return []
    pos, first = np.unique(pos, return_index=True)  # rows that repeat a document name a window more than once
    ref = ref[first]
    new = np.flatnonzero(np.r_[True, (pos[1:] > pos[:-1] + 1) | (ref[1:] != ref[:-1])])
    last = np.r_[new[1:], len(pos)] - 1
    return [(int(pos[a]), int(pos[b] - pos[a]) + window, int(ref[a])) for a, b in zip(new, last)]


def _removed(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = text_column(part, "text").cast(pa.large_binary()).to_pylist()
                kept, n_words, n_removed, spans = [], [], [], []
                for text, found in zip(texts, part.column("found")):
                    words = text.split()
                    n_words.append(len(words))
                    if found.is_valid and len(found.values):
                        refs = found.values.field("refs")
                        sizes = refs.value_lengths().to_numpy(zero_copy_only=False)
                        pos = np.repeat(found.values.field("pos").to_numpy(zero_copy_only=False), sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                        flat = refs.flatten()
                        some = flat.is_valid().to_numpy(zero_copy_only=False)
                        parsed = factors(pos[some], flat.fill_null(0).to_numpy(zero_copy_only=False)[some], window)
                        keep = np.ones(len(words), bool)
                        for start, size, _ in parsed:
                            keep[start: start + size] = False
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                        spans.append([{"start": a, "words": n, "ref": r} for a, n, r in parsed])
                    else:
                        spans.append([])
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                own = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                       pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref", pa.int64())])))]
                names = ["doc_id", *(["text", "rest"] if "rest" in part.schema.names else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *own], [*names, "n_words", "n_removed", "kept_text", "factors"])
    return run


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, n_words,
    n_removed, kept_text (kept words joined by one space) and factors (start
    word, words, reference document). With ``keep``, text and these columns of
    ``docs`` come along; other columns are ignored."""
    rest = [F.struct(*keep).alias("rest")] if keep else []
    texts = docs.select("doc_id", "text", *rest)
    found = matches(texts, window, anchor).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "refs")).alias("found"))
    known = texts.where("doc_id IS NOT NULL").join(found, "doc_id", "left")  # without rest, the same exchange of texts as in matches()
    none = texts.where("doc_id IS NULL").withColumn("found", F.lit(None).cast("array<struct<pos:int,refs:array<long>>>"))
    carried = f"text string, rest {texts.schema['rest'].dataType.simpleString()}, " if keep else ""
    out = known.unionByName(none).mapInArrow(_removed(window), f"doc_id long, {carried}n_words long, n_removed long, kept_text string, factors array<struct<start:long,words:long,ref:long>>")
    return out.select("*", "rest.*").drop("rest") if keep else out
