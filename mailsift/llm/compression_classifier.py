"""Quality classifier by compression.

Two zstandard dictionaries are trained on blocks of good and bad labelled text.
A text is cut into blocks (short ones, so that the dictionary and not the
text's own past decides), each block is compressed with either dictionary, and
the score rests on the normalised difference of the two total sizes,
(bad - good) / (bad + good), positive where the good dictionary fits better. A
logistic curve fitted to labelled rows turns the difference into a probability.

The fit uses a bounded sample: at most MAX_ROWS labelled rows of each class, in
the order of a hash of their id, and at most MAX_BYTES of text of each class.
Half of the rows train the dictionaries, the other half the curve, so the curve
sees texts the dictionaries do not know. Scoring reads every whole text.

Defined results: null or empty texts have difference 0; rows without a label,
or whose label is neither 0 nor 1, are not learned from; with no labelled rows
of a class all scores are the share of good rows learned (0.5 without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.words import slices, text_column

MAX_ROWS = 3000
MAX_BYTES = 16 << 20
DICTIONARY = 64 << 10
BLOCK = 512
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _blocks(text: bytes) -> list[bytes]:
    return [text[i: i + BLOCK] for i in range(0, len(text), BLOCK)]


class Scorer:
    """Normalised size differences and scores of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.compressors = []
        for raw in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
            if dictionary:
                dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        good, bad = (sum(len(c.compress(b)) for b in _blocks(text)) for c in self.compressors)
        return (bad - good) / (bad + good) if good + bad else 0.0

    def score(self, text: bytes) -> float:
        z = self.model.slope * self.difference(text) + self.model.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _dictionary(texts: list[bytes]) -> bytes:
    """Dictionary content of blocks of the texts: trained where there is
    enough text, else the text itself."""
    blocks = [b for t in texts for b in _blocks(t)]
    if sum(map(len, blocks)) > 8 * DICTIONARY and len(blocks) >= 64:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    return b"".join(blocks)[:DICTIONARY]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method with a slight ridge."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):
        rows = known.where(F.col("quality") == label).orderBy(order, "doc_id").limit(max_rows)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    # At most 2 * max_rows ids are broadcast and as many texts fetched.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text", order.alias("order")).orderBy("order").limit(2 * max_rows).toLocalIterator()
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for row in rows:
        text = (row["text"] or "").encode()
        if held[row["quality"]] + len(text) <= max_bytes:
            held[row["quality"]] += len(text)
            texts[row["quality"]].append(text)
    seen = len(texts[0]) + len(texts[1])
    share = len(texts[1]) / seen if seen else 0.5
    if not texts[0] or not texts[1]:
        return Model(b"", b"", 0.0, math.log((share + 1e-9) / (1 - share + 1e-9)))
    draft = Scorer(Model(_dictionary(texts[1][::2]), _dictionary(texts[0][::2]), 1.0, 0.0))
    rest = [(t, label) for label in (0, 1) for t in (texts[label][1::2] or texts[label])]
    x = np.array([draft.difference(t) for t, _ in rest])
    slope, offset = _logistic(x, np.array([label for _, label in rest], float))
    return Model(draft.model.good, draft.model.bad, slope, offset)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                texts = text_column(part, "text").cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([scorer.score(t) for t in texts], pa.float64())], ["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: the probability of a good text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scores(model), f"doc_id {kind}, score double")
