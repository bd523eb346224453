"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised, ended by id 0 and cut into pieces of at most
``length`` tokens. How many pieces of each length there are (at most ``length``
numbers, whatever the corpus) is all that packing depends on, so the driver
solves it on these counts, and Spark deals the pieces out:

* The incumbent is the best-fit-decreasing packing of all pieces.
* Branch and bound over all counts: the largest remaining piece is completed by
  a filling of the rest of its sequence, and as many equal sequences are made as
  the counts and the waste allow. Every undominated filling comes up, the fullest
  first (the sums that the remaining sizes can make are bits of one number, so none
  is searched in vain), and every smaller number of equal sequences. A filling is
  dominated where one remaining piece could take the place of some of its pieces
  of no greater sum: exchanging them loses nothing and leads to an earlier filling
  in this order, so some optimum holds no dominated one. A branch ends
  when its waste is more than a packing better than the incumbent may have. What
  is left is packed by best fit as well, each time it is a tenth smaller and at
  every step of the last few hundred pieces; a better whole is the new incumbent. The
  search ends at the lower bound, when nothing is left to search (the result is
  then optimal), or after NODES steps with the best packing found.
* A length class's pieces are ranked in parallel (in salted buckets, so one
  hot length is no hot task); the rank decides sequence and offset.

Defined results: null or empty text is the ending id alone; rows that repeat an
id are packed each for itself; ids may be null.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.tables import handoff
from mailsift.llm.words import slices, text_column

LENGTH = 2048
#: Steps of the branch and bound, about a millisecond each on the driver.
NODES = 20_000
#: So few pieces are packed by best fit as well at every step.
SMALL = 300


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(length: int, path: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mailsift.llm.tokens import Encoder

        encoder = Encoder.of(path or default_tokenizer())
        for batch in batches:
            for part in slices(batch):
                rows, piece, start, size, crc, raw = [], [], [], [], [], []
                for row, ids in enumerate(encoder.encode(text_column(part, "text").to_pylist())):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    edges = [0, *range(n % length or length, n, length), n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a: 4 * b]))
                        if with_ids:
                            raw.append(ids[4 * a: 4 * b])
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        encoder.forget()  # the worker may go on with other stages
    return run


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length,
    ids_crc32 and, on request, ids (little-endian uint32 bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_cut(length, tokenizer, with_ids), columns)


Bin = tuple[int, ...]


def _reach(counts: np.ndarray, room: int) -> tuple[list[int], list[int], list[int]]:
    """Sizes up to ``room`` that are left, ascending, their counts, and for each
    k the sums up to ``room`` of pieces of the k smallest sizes, as bits."""
    sizes = np.flatnonzero(counts[: room + 1]).tolist()
    many = counts[sizes].tolist()
    full, bits, reach = (1 << (room + 1)) - 1, 1, [1]
    for size, n in zip(sizes, many):
        n, step = min(n, room // size), 1
        while n > 0:
            step = min(step, n)
            bits |= bits << (step * size) & full
            n -= step
            step *= 2
        reach.append(bits)
    return sizes, many, reach


def _filled(sizes: list[int], many: list[int], reach: list[int], k: int, total: int) -> Bin:
    """The filling of sum ``total`` (one exists) from the k smallest sizes with
    the largest pieces first."""
    chosen: list[int] = []
    while total:
        k = min(k, bisect_right(sizes, total))
        size = sizes[k - 1]
        n = min(many[k - 1], total // size)
        while not reach[k - 1] >> (total - n * size) & 1:
            n -= 1
        chosen += [size] * n
        total -= n * size
        k -= 1
    return tuple(chosen)


def _filling(counts: np.ndarray, room: int, after: Bin | None) -> Bin | None:
    """The next filling of ``room`` behind ``after`` (None: the first). All
    fillings come in one order whatever the counts: the fullest first, then
    those with the largest pieces."""
    sizes, many, reach = _reach(counts, room)
    below = reach[-1]
    if after is not None:
        total, parts = sum(after), [(s, after.count(s)) for s in dict.fromkeys(after)]
        for j in range(len(parts) - 1, -1, -1):
            head = parts[:j]
            if any(counts[s] < n for s, n in head):
                continue
            size, n = parts[j]
            k = bisect_left(sizes, size)
            for fewer in range(min(n - 1, int(counts[size])), -1, -1):
                left = total - sum(s * m for s, m in head) - fewer * size
                if reach[k] >> left & 1:
                    return tuple(s for s, m in [*head, (size, fewer)] for _ in range(m)) + _filled(sizes, many, reach, k, left)
        below &= (1 << total) - 1
    return _filled(sizes, many, reach, len(sizes), below.bit_length() - 1) if below else None


def _dominated(counts: np.ndarray, room: int, filling: Bin) -> bool:
    """Whether a piece that is left could replace pieces of the filling of no
    greater sum (two or more, or one smaller piece, or none) within the room."""
    spare = room - sum(filling)
    one, more = 0, 0  # sums of one and of at least two of the pieces, as bits
    for size in filling:
        more |= (more | one) << size
        one |= 1 << size

    def widened(bits: int, by: int) -> int:
        """``bits`` moved up by 0 to ``by``."""
        step = 1
        while by > 0:
            step = min(step, by)
            bits |= bits << step
            by -= step
            step *= 2
        return bits

    used = np.bincount(filling, minlength=room + 1) if filling else np.zeros(room + 1, np.int64)
    left = sum(1 << size for size in np.flatnonzero(counts[: room + 1] > used[: len(counts[: room + 1])]).tolist())
    replaced = widened(more, spare) | (widened((one | 1) << 1, spare - 1) if spare else 0)
    return bool(left & replaced)


def _best_fit(counts: np.ndarray, length: int) -> list[tuple[Bin, int]]:
    """Best-fit decreasing, equal sequences at once: the incumbent."""
    by_room: dict[int, list[tuple[Bin, int]]] = {}
    rooms: list[int] = []  # ascending

    def put(room: int, one: Bin, times: int) -> None:
        if times:
            if not by_room.setdefault(room, []):
                insort(rooms, room)
            by_room[room].append((one, times))

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, one, times = length, (), left
            else:
                room = rooms[at]
                one, times = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            each = room // size  # the fullest sequence that a piece fits is the one that just took one
            whole = min(times, left // each)
            put(room - each * size, one + (size,) * each, whole)
            left -= whole * each
            if whole < times and left:
                put(room - left * size, one + (size,) * left, 1)
                whole, left = whole + 1, 0
            if room < length or one:
                put(room, one, times - whole)
    return [group for groups in by_room.values() for group in groups]


def least_bins(counts: np.ndarray, length: int) -> int:
    """A lower bound: pieces above half a sequence never share one; smaller
    pieces of at least k tokens fill the room of those that leave k or more."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // length)
    for k in range(length // 2 + 1):
        alone = int(counts[size > length - k].sum())
        halves = (size > length // 2) & (size <= length - k)
        rest = int((counts * size)[(size >= max(k, 1)) & (size <= length // 2)].sum())
        room = int((counts * (length - size))[halves].sum())
        best = max(best, alone + int(counts[halves].sum()) + max(0, -(-(rest - room) // length)))
    return best


def plan(counts: np.ndarray, length: int = LENGTH, nodes: int = NODES) -> list[tuple[Bin, int]]:
    """(lengths in a sequence, number of such sequences) for ``counts[n]``
    pieces of each length n."""
    counts = counts.astype(np.int64).copy()
    total, least = int((counts * np.arange(len(counts))).sum()), least_bins(counts, length)
    best = _best_fit(counts, length)
    fewest = sum(times for _, times in best)
    made: list[tuple[Bin, int]] = []
    bins = waste = 0  # of made
    after: Bin | None = None
    tried = 2 * int(counts.sum())  # pieces that were left when best fit was last tried on them

    def take(chosen: Bin, times: int) -> None:
        nonlocal bins, waste
        np.subtract.at(counts, list(chosen), times)
        bins += times
        waste += times * (length - sum(chosen))

    while fewest > least and nodes > 0:
        spare = (fewest - 1) * length - total - waste  # a better packing leaves no more room than this in its further sequences
        if spare >= 0:
            if not counts.any():
                best, fewest = list(made), bins
                continue
            nodes -= 1
            left = int(counts.sum())
            if made and (left <= SMALL or left <= 0.9 * tried):
                tried = left
                rest = _best_fit(counts, length)
                if bins + sum(times for _, times in rest) < fewest:
                    best = made + rest
                    fewest = sum(times for _, times in best)
                    continue
            largest = int(np.flatnonzero(counts)[-1])
            counts[largest] -= 1
            if after is None and made and made[-1][0][0] == largest:
                after = made[-1][0][1:]  # sequences with equal largest pieces come in the order of their fillings
            filling = _filling(counts, length - largest, after)
            while filling is not None and nodes > 0 and _dominated(counts, length - largest, filling):
                nodes -= 1
                filling = _filling(counts, length - largest, filling)
            counts[largest] += 1
            after = None
            if filling is not None:
                chosen = (largest, *filling)
                sizes, uses = np.unique(chosen, return_counts=True)
                times = int((counts[sizes] // uses).min())
                room = length - sum(chosen)
                if room * times > spare:
                    times = spare // room
                if times:
                    made.append((chosen, times))
                    take(chosen, times)
                    continue
        if not made:
            break  # the whole tree is searched: the best is optimal
        chosen, times = made.pop()
        take(chosen, -times)
        if times > 1:
            made.append((chosen, times - 1))
            take(chosen, times - 1)
        else:
            after = chosen[1:]
    return best


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``pieces`` of ``docs`` and sequence_id and offset (place in the
    sequence, in tokens)."""
    cut = handoff(pieces(docs, length, tokenizer, with_ids), "pieces")
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `length` rows
    counts = np.zeros(length + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    spark, runs, base, used = docs.sparkSession, [], 0, np.zeros(length + 1, np.int64)
    for chosen, times in plan(counts, length):
        offset = 0
        for size, many in ((s, chosen.count(s)) for s in dict.fromkeys(chosen)):
            runs.append((size, int(used[size]), int(used[size]) + many * times, base, many, offset))
            used[size] += many * times
            offset += many * size
        base += times
    salts = max(1, math.ceil(math.sqrt(counts.sum()) / 8))
    ranked = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = ranked.groupBy("length", "salt").agg(F.count("*").alias("c"))
    before = before.select("length", "salt", (F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")).alias("before"))
    ranked = (ranked.join(before, ["length", "salt"])
              .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1))
    # The runs are as many as the plan's distinct sequences hold lengths: bounded by the length classes, not by the corpus.
    where = handoff(spark.createDataFrame(runs, "run_length long, low long, high long, base long, many long, place long"), "runs")
    out = ranked.join(where, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return out.select(*cut.columns, F.expr("base + (rank - low) div many").alias("sequence_id"), F.expr("place + ((rank - low) % many) * length").alias("offset"))
