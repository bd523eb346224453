"""SentencePiece encoding by forward filtering, backward sampling; decoding.

A text is cut before each space; a unit is a space and what follows it (one
space is put before the text). The pieces that match inside a unit span a
lattice over its bytes. Forward filtering sums the probability of all ways to
reach each byte; backward sampling draws the last piece of the unit from those
that end there, then the piece before it, and so on, which draws each
segmentation with its probability. A piece's probability falls with its rank in
the vocabulary as 1 / (rank + RANK_OFFSET), raised to ``sharpness``.

Draws come from a hash of the row's key, the unit's place and the step, so a
row's segmentation is the same on every run and partitioning.

Lossless: a character without a piece of its own (also a literal U+2581) is
spelled by byte pieces, no text is normalised, and spaces are kept one by one,
so decoding gives back the text. Lattices are computed for the distinct units of
a slice, GROUP bytes at a time; a worker remembers MAX_BYTES of them.

The vocabulary's own scores are merge ranks, no probabilities; the weights here
are made from these ranks, and pieces with a space inside are left out.

Defined results: null or empty text has no ids; rows with equal keys draw alike
(a null key is a key). A unit of more than WINDOW bytes (text without spaces) is
cut at characters into windows of at most so many bytes, which are drawn one by
one and not remembered: no piece crosses such a cut, and a text's memory follows
its length and GROUP, never a lattice of its whole length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.words import mix, slices, text_column

RANK_OFFSET = 10
#: Probability weight of a byte piece, that of a piece of this rank.
BYTE_RANK = 1_000_000
MAX_BYTES = 224 << 20
#: Bytes whose lattices are computed at once (a bound on working memory).
GROUP = 128 << 10
#: Longer units are cut; shorter ones are remembered.
WINDOW = 256
#: Bytes that a remembered unit takes besides its lattice.
ENTRY = 250
_B = np.uint64(0x100000001B3)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary: byte strings (a space for the word mark), ids, weights."""

    _made: dict[tuple, "Pieces"] = {}

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        self.weight = np.zeros(model.get_piece_size())
        self.byte_id = np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            raw = b""
            if model.is_byte(i):
                raw = bytes([int(piece[3:5], 16)])
                self.byte_id[raw[0]] = i
                self.weight[i] = -sharpness * np.log(BYTE_RANK)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = piece.replace("▁", " ").encode()
                if b" " not in raw[1:]:  # units hold one space, their first byte
                    by_length.setdefault(len(raw), []).append((raw, i))
                    self.weight[i] = -sharpness * np.log(max(0.0, -model.get_score(i)) + RANK_OFFSET)
            self.bytes.append(raw)
        self.longest = max(by_length)
        # Of each length the hashes of all beginnings of pieces, sorted, with the id where a whole piece (else -1).
        begins: dict[int, dict[bytes, int]] = {k: {} for k in range(1, self.longest + 1)}
        for n, found in by_length.items():
            for raw, i in found:
                for k in range(1, n):
                    begins[k].setdefault(raw[:k], -1)
                begins[n][raw] = i
        self.begins = {}
        for k, known in begins.items():
            h = self._hash(list(known))
            order = np.argsort(h)
            self.begins[k] = (h[order], np.fromiter(known.values(), np.int64, len(known))[order])

    @classmethod
    def of(cls, path: str, sharpness: float) -> "Pieces":
        if (path, sharpness) not in cls._made:
            cls._made[path, sharpness] = cls(path, sharpness)
        return cls._made[path, sharpness]

    @staticmethod
    def _hash(strings: list[bytes]) -> np.ndarray:
        n = len(strings[0])
        data = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, n)
        h = np.zeros(len(strings), np.uint64)
        for k in range(n):
            h = mix(h * _B + data[:, k] + np.uint64(1))
        return h

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


class _Grown:
    """An array that grows at its end, copied once each time its size doubles."""

    def __init__(self, kind: type, *start: int):
        self.held, self.n = np.array(start, kind), len(start)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            room = np.empty(max(2 * self.n, self.n + len(x)), self.held.dtype)
            room[: self.n] = self.held[: self.n]
            self.held = room
        self.held[self.n: self.n + len(x)] = x
        self.n += len(x)

    def cut(self, n: int) -> None:
        self.held, self.n = self.held[:n].copy(), n


class Lattices:
    """Backward choices of distinct units: for unit u and end byte e the
    entries ``choice[node[u] + e] : choice[node[u] + e + 1]``. A unit that begins
    with a space is a window that goes on without one."""

    _made: dict[int, "Lattices"] = {}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.index: dict[bytes, int] = {}
        self.begin, self.size = _Grown(np.int64), _Grown(np.int64)
        self.node, self.choice = _Grown(np.int64, 0), _Grown(np.int64, 0)
        self.length, self.id, self.upto = _Grown(np.int16), _Grown(np.int32), _Grown(np.float32)

    @classmethod
    def of(cls, pieces: Pieces) -> "Lattices":
        """The worker's lattices of a vocabulary."""
        return cls._made.setdefault(id(pieces), cls(pieces))

    def add(self, units: list[bytes]) -> None:
        """Lattices of new units, GROUP bytes at a time."""
        for group in grouped(units):
            begin, size, choice, length, piece, upto = self._made_of(group)
            self.index.update(zip(group, range(self.size.n, self.size.n + len(group))))
            self.node.add(self.node.held[self.node.n - 1] + np.cumsum(size + 1))
            self.choice.add(self.id.n + np.cumsum(choice))
            for held, x in ((self.begin, begin), (self.size, size), (self.length, length), (self.id, piece), (self.upto, upto)):
                held.add(x)

    def _made_of(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """(first and last byte of each unit, choices per node, and of each choice
        its length, id and running probability)."""
        p = self.pieces
        goes_on = np.fromiter((u[:1] == b" " for u in units), bool, len(units))
        spaced = [u if u[:1] == b" " else b" " + u for u in units]
        data = np.frombuffer(b"".join(spaced), np.uint8)
        size = np.fromiter(map(len, spaced), np.int64, len(units))
        base = np.cumsum(size) - size
        end_of = np.repeat(base + size, size)
        live = np.arange(len(data))
        h = np.zeros(len(data), np.uint64)
        starts, lengths, ids = [], [], []
        single = np.zeros(len(data), bool)  # a character with a piece of its own
        width = np.ones(len(data), np.int64)
        width[data >= 0xC0] = 2
        width[data >= 0xE0] = 3
        width[data >= 0xF0] = 4
        for k in range(1, p.longest + 1):
            live = live[live + k <= end_of[live]]
            if not len(live):
                break
            h[live] = mix(h[live] * _B + data[live + k - 1] + np.uint64(1))
            table, piece = p.begins[k]
            at = np.minimum(np.searchsorted(table, h[live]), len(table) - 1)
            known = table[at] == h[live]
            live, at = live[known], piece[at[known]]
            whole = at >= 0
            starts.append(live[whole])
            lengths.append(np.full(len(starts[-1]), k))
            ids.append(at[whole])
            single[starts[-1][width[starts[-1]] == k]] = True
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        spelled = np.flatnonzero(~single[np.flatnonzero(lead)][char])
        starts.append(spelled)
        lengths.append(np.ones(len(spelled), np.int64))
        ids.append(p.byte_id[data[spelled]])
        start, length, piece = (np.concatenate(x) for x in (starts, lengths, ids))
        unit = np.searchsorted(base, start, side="right") - 1
        real = ~(goes_on[unit] & (start == base[unit]))
        start, length, piece, unit = start[real], length[real], piece[real], unit[real]
        end = start + length  # node numbers: byte ends, one extra start node per unit
        node_end, node_start = end + unit, start + unit
        order = np.argsort(node_end, kind="stable")
        node_end, node_start, length, piece, unit = (x[order] for x in (node_end, node_start, length, piece, unit))
        total = len(data) + len(units)
        alpha = np.full(total, -np.inf)
        alpha[base + np.arange(len(units)) + goes_on] = 0
        weight = p.weight[piece]
        local = node_end - (base + np.arange(len(units)))[unit]
        by_end = np.argsort(local, kind="stable")
        cuts = np.searchsorted(local[by_end], np.arange(1, int(local.max(initial=0)) + 2))
        for a, b in zip(cuts, cuts[1:]):
            edges = by_end[a:b]
            if len(edges):
                x = alpha[node_start[edges]] + weight[edges]
                first = np.flatnonzero(np.r_[True, np.diff(node_end[edges]) > 0])
                top = np.maximum.reduceat(x, first)
                safe = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    alpha[node_end[edges][first]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.r_[first, len(x)]))), first))
        with np.errstate(invalid="ignore"):
            share = np.nan_to_num(np.exp(alpha[node_start] + weight - alpha[node_end]))
        running = np.cumsum(share)
        choice = np.searchsorted(node_end, np.arange(total + 1))
        before = np.r_[0.0, running][choice[node_end]]
        return goes_on.astype(np.int64), size, np.diff(choice), length.astype(np.int16), piece.astype(np.int32), (running - before).astype(np.float32)

    def bytes(self) -> int:
        return ENTRY * self.size.n + 8 * (self.choice.n + 3 * self.size.n) + 10 * self.id.n

    def keep(self, most: int) -> None:
        """Beyond ``most`` bytes, forget all but the first units of half of it."""
        if self.bytes() > most:
            node = self.node.held[: self.node.n]
            taken = ENTRY * np.arange(len(node)) + 8 * node + 10 * self.choice.held[node]
            n = int(np.searchsorted(taken, most // 2))
            self.index = dict(islice(self.index.items(), n))
            nodes = int(node[n])
            entries = int(self.choice.held[nodes])
            for held, k in ((self.begin, n), (self.size, n), (self.node, n + 1), (self.choice, nodes + 1), (self.length, entries), (self.id, entries), (self.upto, entries)):
                held.cut(k)

    def sample(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in order, ids per unit) for occurrences of units."""
        nodes, choice, length, piece, upto = (x.held for x in (self.node, self.choice, self.length, self.id, self.upto))
        at, floor = self.size.held[unit], self.begin.held[unit]
        live = np.arange(len(unit))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            node = nodes[unit[live]] + at[live]
            draw = (mix(seed[live] + np.uint64(len(steps) + 1)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            entry, last = choice[node], choice[node + 1] - 1
            while True:
                more = (draw >= upto[entry]) & (entry < last)
                if not more.any():
                    break
                entry = entry + more
            steps.append((live, piece[entry]))
            at[live] -= length[entry]
            live = live[at[live] > floor[live]]
        count = np.zeros(len(unit), np.int64)
        for occurrence, _ in steps:
            count[occurrence] += 1
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (occurrence, chosen) in enumerate(steps):
            ids[ends[occurrence] - 1 - k] = chosen
        return ids, count


def grouped(units: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive units of at most GROUP bytes together (at least one)."""
    start = held = 0
    for i, unit in enumerate(units):
        if held and held + len(unit) > GROUP:
            yield units[start:i]
            start, held = i, 0
        held += len(unit) + 1
    if start < len(units):
        yield units[start:]


def _windows(unit: bytes) -> list[bytes]:
    """A long unit cut at characters, further windows marked by a space."""
    edges = [0]
    while len(unit) - edges[-1] > WINDOW:
        end = edges[-1] + WINDOW
        while end > edges[-1] + 1 and unit[end] & 0xC0 == 0x80:
            end -= 1
        edges.append(end)
    return [b" " * (a > 0) + unit[a:b] for a, b in zip(edges, [*edges[1:], len(unit)])]


def _drawn(lattices: Lattices, units: list[bytes], seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, ids per unit) of a slice's units."""
    known = lattices.index
    short = np.fromiter(map(len, units), np.int64, len(units)) < WINDOW
    at = np.flatnonzero(short)
    remembered = units if len(at) == len(units) else [units[i] for i in at.tolist()]
    new = set(remembered).difference(known)
    if new:
        lattices.add(list(new))
    drawn = lattices.sample(np.fromiter(map(known.__getitem__, remembered), np.int64, len(at)), seed[at])
    if len(at) == len(units):
        return drawn
    parts = [(at, *drawn)]
    at = np.flatnonzero(~short)
    done = 0
    for group in grouped([units[i] for i in at.tolist()]):
        scratch = Lattices(lattices.pieces)
        scratch.add(list(dict.fromkeys(group)))
        here = at[done: done + len(group)]
        parts.append((here, *scratch.sample(np.fromiter(map(scratch.index.__getitem__, group), np.int64, len(group)), seed[here])))
        done += len(group)
    count = np.zeros(len(units), np.int64)
    for here, _, n in parts:
        count[here] = n
    first = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), np.int32)
    for here, found, n in parts:
        ids[np.repeat(first[here] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    return ids, count


def _encode(model: str | None, sharpness: float, check: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model or default_model(), sharpness)
        lattices = Lattices.of(pieces)
        for batch in batches:
            for part in slices(batch):
                texts = text_column(part, "text").cast(pa.large_binary()).to_pylist()
                cut = [t.split(b" ") if t else [] for t in texts]
                cut = [c if max(map(len, c), default=0) <= WINDOW else [w for u in c for w in (_windows(u) if len(u) > WINDOW else (u,))] for c in cut]
                lattices.keep(MAX_BYTES)
                sizes = np.fromiter(map(len, cut), np.int64, len(cut))
                place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
                seed = mix(np.repeat(mix(key), sizes) + mix(place.astype(np.uint64)))
                ids, count = _drawn(lattices, list(chain.from_iterable(cut)), seed)
                edges = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(sizes)]]
                columns, names = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"]
                if check:
                    listed, ends = ids.tolist(), edges.tolist()
                    columns.append(pa.array([zlib.crc32(pieces.decode(listed[a:b])) for a, b in zip(ends, ends[1:])], pa.int64()))
                    names.append("decoded_crc32")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def encode(docs: DataFrame, seed: int = 11, sharpness: float = 1.0, model: str | None = None, check: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: a segmentation drawn by the row's doc_id and
    ``seed``; with ``check`` also decoded_crc32 of the text the ids decode to."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(seed)).alias("key")).mapInArrow(_encode(model, sharpness, check), f"doc_id {kind}, ids array<int>" + ", decoded_crc32 long" * check)


def _decode(model: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model or default_model(), 1.0)
        for batch in batches:
            flat = batch.column("ids")
            texts = [pieces.decode(ids.as_py() or []) for ids in flat]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])
    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), f"doc_id {kind}, text string")
