"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model learnt from all training rows. Its states are
contexts (the last ``order`` - 1 tokens or fewer, a text beginning in the state of
the start mark); a state has an arc for every token seen after its context, and
a failure arc to the context without its first token. With Dirichlet smoothing
a seen token's arc weighs (c(hw) + mu p(w | h')) / (c(h) + mu), the failure arc
mu / (c(h) + mu), where h' is the shorter context; the empty context gives
(c(w) + 1) / (N + V + 1), unknown tokens included. The weights of each state sum
to one over all known tokens and one unknown.

The automaton grows with the corpus, so no task holds it. Texts are cut into
slices of a few megabytes; each slice states the distinct n-grams that it needs,
with their training counts, as sorted keys packed by key range (``bucket``); the
counts of all slices meet by bucket and go back, in the order asked for, to the
slices. With them each slice builds the part of the automaton that its texts can
reach, and one pass from left to right takes every text through it. The state
after a token depends on the last ``order`` - 1 tokens only, so the pass
advances all positions of a slice at once, order by order, with numpy. A common
n-gram is sent once a slice, however often it occurs.

Defined results: null text is an empty one, whose one token is the end mark; rows
with a null id count and are scored like others; repeated rows count each time;
with nothing to learn from every token is unknown and weighs one. N-grams compare
by 64-bit hashes. Memory follows SLICE bytes and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.tables import drop_handoff, handoff
from mailsift.llm.words import Words, mix, slices, text_column

ORDER = 2
#: The weight of the shorter context against the counts of a longer one.
MU = 64.0
SLICE = 6 << 20
#: Keys a bucket should hold.
BUCKET_KEYS = 1 << 20
_BEGIN, _END = (mix(np.array([n], np.uint64))[0] for n in (0xB0B0, 0xE0E0))
_ODD = np.uint64(0xD6E8FEB86659FD93)
_TEXTS = "slice long, n_tokens long, n_keys long, train_tokens long, ids array<string>, held array<boolean>, sizes binary, tokens binary, vocabulary binary"
_ASKED = "slice long, gram int, bucket int, keys binary, counts binary"
_TOLD = "slice long, gram int, bucket int, counts binary, known long"


def _pack(x: np.ndarray) -> bytes:
    """Bytes plane by plane (leading bytes of small or sorted numbers are alike), compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


class _Slice:
    """Tokens of consecutive texts: ``token`` (number in the slice's vocabulary
    of each token, the start mark before and the end mark after every text's
    words), ``key`` (hash by number), ``size`` (tokens of each text, marks
    included), ``held`` (texts that are not learnt from)."""

    def __init__(self, token: np.ndarray, key: np.ndarray, size: np.ndarray, held: np.ndarray):
        self.token, self.key, self.size, self.held = token, key, size, held
        self.first = np.cumsum(size) - size
        self.place = np.arange(len(token)) - np.repeat(self.first, size)
        self.train = np.repeat(~held, size)

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For k = 1 .. order: (k, sorted distinct keys, the key number of the
        k-gram that ends at each position or -1, training count by key)."""
        number, key = self.token.astype(np.int64), self.key
        for k in range(1, order + 1):
            if k > 1:
                ends = np.flatnonzero((self.place >= k - 1) & (self.place > 0))
                pair = number[ends - 1] * len(self.key) + self.token[ends]
                found, at = np.unique(pair, return_inverse=True)
                key = mix(key[found // len(self.key)] * _ODD + self.key[found % len(self.key)] + np.uint64(k))
                number = np.full(len(self.token), -1, np.int64)
                number[ends] = at
            rank = np.argsort(key)
            to = np.empty(len(key), np.int64)
            to[rank] = np.arange(len(key))
            key = key[rank]
            number = np.where(number < 0, -1, to[number])
            counts = np.bincount(number[self.train & (number >= 0)], minlength=len(key)).astype(np.uint32)
            yield k, key, number, counts


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, held, text) as slices of token numbers."""
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            words = Words(text_column(part, "text"), lower=True)
            n = np.diff(words.first)
            size = n + 2
            hashes = np.full(int(size.sum()), _END, np.uint64)
            first = np.cumsum(size) - size
            hashes[first] = _BEGIN
            inner = np.ones(len(hashes), bool)
            inner[first] = inner[first + size - 1] = False
            hashes[inner] = words.hash
            key, token, often = np.unique(hashes, return_inverse=True, return_counts=True)
            rank = np.argsort(-often, kind="stable")  # common tokens get small numbers, which pack well
            to = np.empty(len(key), np.uint32)
            to[rank] = np.arange(len(key), dtype=np.uint32)
            held = part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            texts = _Slice(to[token], key[rank], size, held)
            yield pa.RecordBatch.from_pydict({
                "slice": [(task << 32) + made], "n_tokens": [len(hashes) - len(size)], "n_keys": [len(key)], "train_tokens": [int((size - 1)[~held].sum())],
                "ids": [part.column(0).to_pylist()], "held": [held.tolist()], "sizes": [_pack(size)], "tokens": [_pack(texts.token)], "vocabulary": [_pack(texts.key)],
            }, schema=_arrow(_TEXTS))
            made += 1


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
             "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def _opened(row: dict) -> _Slice:
    return _Slice(_unpack(row["tokens"], np.uint32), _unpack(row["vocabulary"], np.uint64), _unpack(row["sizes"], np.int64), np.array(row["held"], bool))


def _cuts(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket (equal ranges of the key's leading bits) begins in sorted keys."""
    return np.searchsorted((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _ask(order: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for k, key, _, counts in _opened(row).grams(order):
                    cuts = _cuts(key, buckets)
                    for low in range(0, buckets, 64):
                        held = [b for b in range(low, min(low + 64, buckets)) if cuts[b] < cuts[b + 1]]
                        parts = [(cuts[b], cuts[b + 1]) for b in held]
                        yield pa.RecordBatch.from_pydict({
                            "slice": [row["slice"]] * len(held), "gram": [k] * len(held), "bucket": held,
                            "keys": [_pack(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in parts], "counts": [_pack(counts[a:b]) for a, b in parts],
                        }, schema=_arrow(_ASKED))
    return ask


def _tell(table: pa.Table) -> pa.Table:
    """The counts of a bucket's keys over all slices, in each slice's order. The
    marks' keys are no unknown words: the start mark is not counted as known."""
    keys = [np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64) for raw in table["keys"].to_pylist()]
    counts = [_unpack(raw, np.uint32) for raw in table["counts"].to_pylist()]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    told = [_pack(total[at[end - len(k): end]]) for k, end in zip(keys, ends.tolist())]
    known = int(((total > 0) & (found != _BEGIN)).sum())
    return pa.table({"slice": table["slice"], "gram": table["gram"], "bucket": table["bucket"], "counts": pa.array(told, pa.binary()),
                     "known": pa.array([known] + [0] * (len(told) - 1), pa.int64())})


def _walk(order: int, mu: float, tokens: int, known: int):
    """One pass through the automaton's part that a slice can reach."""
    def walk(texts: pa.Table, told: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        part = _opened(row)
        gram, bucket, raw = (told[name].to_pylist() for name in ("gram", "bucket", "counts"))
        base = p = seen = context = None
        for k, _, number, _ in part.grams(order):
            mine = sorted((b, i) for i, (g, b) in enumerate(zip(gram, bucket)) if g == k)
            total = np.concatenate([_unpack(raw[i], np.uint64) for _, i in mine]).astype(np.float64)
            count = np.where(number < 0, 0.0, total[number])
            if k == 1:
                base = p = (count + 1) / (tokens + known + 1)
                seen = count > 0
            else:
                # The state's context is the (k - 1)-gram up to the token before; an unseen one falls through its failure arc at no cost.
                h = np.concatenate([[0.0], context[:-1]])
                longer = number >= 0
                p = np.where(longer, (count + mu * p) / (h + mu), p)
            context = count
        real = part.place > 0  # all but the start mark
        text = np.repeat(np.arange(len(part.size)), part.size)[real]
        add = lambda x: np.bincount(text, weights=x[real], minlength=len(part.size))
        return pa.table({"id": pa.array(row["ids"], pa.string()), "held": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(part.size - 1, pa.int64()),
                         "n_known": pa.array(add(seen.astype(float)).astype(np.int64)), "train_tokens": pa.array([tokens] * len(part.size), pa.int64()),
                         "base_score": pa.array(add(np.log10(base))), "score": pa.array(add(np.log10(p)))})
    return walk


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, mu: float = MU) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every
    row of ``docs``, learning from the rows where ``held_out`` is not true.
    base_score is the log10 probability by add-one counts of single tokens, score
    that of the automaton. Other columns of ``docs`` are not read."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast("string").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    texts = handoff(rows.mapInArrow(_read, _TEXTS), "texts")
    size = texts.agg(F.sum("n_tokens").alias("tokens"), F.sum("train_tokens").alias("train"), F.sum("n_keys").alias("keys")).first()
    buckets = max(1, ((size["tokens"] or 0) * max(1, order - 1) + (size["keys"] or 0)) // BUCKET_KEYS)
    asked = texts.mapInArrow(_ask(order, buckets), _ASKED)
    told = handoff(asked.groupBy("gram", "bucket").applyInArrow(_tell, _TOLD), "told")
    known = told.where("gram = 1").agg(F.sum("known")).first()[0] or 0
    out = texts.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(
        _walk(order, mu, size["train"] or 0, known),
        "id string, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
