"""Token ids of whole texts by a public byte-level BPE tokenizer.

The tokenizer never merges across a single space between two non-space
characters, so a text is cut there and each distinct chunk is encoded once per
worker; the ids of a text are its chunks' ids in order, equal to encoding it
whole. A special token's string has its id as in plain encoding: it holds no
space, so it stays within one chunk.

Chunks of more than UNIT characters (text without spaces, encoded strings) are
encoded where they stand and not remembered. What is remembered is bounded by
MAX_BYTES of chunks, ids and bookkeeping; beyond that the half learned first
stays, which holds the commonest.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

MAX_BYTES = 256 << 20
UNIT = 128
#: Bytes of a remembered chunk besides its characters and ids.
ENTRY = 190
_SPACES = r"\s\x1c-\x1f\x85᠎​﻿"
#: A space next to white space (of any tokenizer's notion) is no place to cut.
_UNSAFE = re.compile(f" (?:(?=[{_SPACES}])|(?<=[{_SPACES}] ))")
_CUT = re.compile(f"(?<=[^{_SPACES}]) (?=[^{_SPACES}])")


class Memory:
    """Ids by chunk, bounded in bytes."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.size = 0

    def learn(self, chunks: list[str], ids: list[bytes]) -> None:
        self.ids.update(zip(chunks, ids))
        self.size += ENTRY * len(chunks) + 2 * sum(map(len, chunks)) + sum(map(len, ids))

    def trim(self, most: int) -> None:
        """Keep the first half where there is more than ``most``."""
        if self.size > most:
            learnt, self.ids, self.size = self.ids, {}, 0
            for chunk, ids in learnt.items():
                self.ids[chunk] = ids
                self.size += ENTRY + 2 * len(chunk) + len(ids)
                if 2 * self.size > most:
                    break


class Encoder:
    """ids of texts as little-endian uint32 bytes."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.later = Memory(), Memory()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The worker's encoder for a vocabulary file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.first, self.later = Memory(), Memory()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], special: list[str]) -> None:
        """Ids of chunks that follow a space: many at once, cut where a token
        begins with a space; one by one where a chunk holds spaces or one
        of the ``special`` tokens (the space before is a token of its own there)."""
        odd = [c for c in chunks if not c or " " in c]
        plain = [c for c in chunks if c and " " not in c]
        if special:
            odd = [c for c in chunks if not c or " " in c or any(s in c for s in special)]
            plain = list(set(plain).difference(odd))
        for at in range(0, len(plain), 512):
            group = plain[at: at + 512]
            ids = self._ids([" " + " ".join(group)])[0]
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(group):
                raw = ids.tobytes()
                ends = [*(4 * starts[1:]).tolist(), len(raw)]
                self.later.learn(group, [raw[a:b] for a, b in zip((4 * starts).tolist(), ends)])
            else:
                odd += group
        self.later.learn(odd, [i.tobytes() for i in self._ids([" " + c for c in odd])])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if _UNSAFE.search(t) else t.split(" ") for t in texts]
        self.first.trim(MAX_BYTES // 4)
        self.later.trim(MAX_BYTES)
        first, later = self.first.ids, self.later.ids
        long = [max(map(len, c)) > UNIT for c in cut]
        new = set().union(*cut).difference(later)  # with the texts' first chunks, which often follow a space elsewhere
        if any(long):
            new = {c for c in new if len(c) <= UNIT}
        if new:
            self._learn(list(new), [s for s in self.special if any(s in t for t in texts)])
        heads = list({c[0] for c in cut if len(c[0]) <= UNIT}.difference(first))
        self.first.learn(heads, [i.tobytes() for i in self._ids(heads)])

        def ids(at: int, chunk: str) -> bytes:
            known = (later if at else first).get(chunk)
            return self._ids([" " + chunk if at else chunk])[0].tobytes() if known is None else known

        return [b"".join([ids(k, x) for k, x in enumerate(c)]) if far else b"".join([first[c[0]], *map(later.__getitem__, islice(c, 1, None))])
                for c, far in zip(cut, long)]
