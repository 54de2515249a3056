"""Token ids of many texts through the distinct chunks that they are made of."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

import numpy as np

from roadledger.llm.common import ragged_take

#: Chunks remembered in a task, in two halves: the older one makes room for a new one once the newer is full.
REMEMBER = 3 << 18
#: Chunks given to the encoder in one call.
AT_ONCE = 1 << 13


class _Memory:
    """Chunks with the places of their ids."""

    def __init__(self):
        self.index: dict = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, chunks: list, ids: list[np.ndarray], size: np.ndarray) -> None:
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks))))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(size) - size)
        self.lengths = np.append(self.lengths, size)
        self.ids = np.concatenate([self.ids, *ids])


class ChunkCache:
    """Encodes distinct chunks; ``encode`` turns a list of chunks into their id sequences.

    A chunk that is met again moves to the newer half of the memory, so common ones are never learnt twice.
    """

    def __init__(self, encode: Callable[[list], Iterable], remember: int = REMEMBER):
        self.encode, self.remember = encode, remember
        self.now, self.before = _Memory(), _Memory()

    def _learn(self, chunks: list) -> None:
        if len(self.now.index) > self.remember // 2:
            self.before, self.now = self.now, _Memory()
        old, index = self.before, self.now.index
        missing = [c for c in dict.fromkeys(chunks) if c not in index]
        known = [c for c in missing if c in old.index]
        if known:
            at = np.fromiter(map(old.index.__getitem__, known), np.int64, len(known))
            self.now.add(known, [ragged_take(old.ids, old.starts[at], old.lengths[at])], old.lengths[at])
        new = [c for c in missing if c not in old.index] if known else missing
        if new:
            found = [np.asarray(x, np.uint32) for i in range(0, len(new), AT_ONCE) for x in self.encode(new[i:i + AT_ONCE])]
            self.now.add(new, found, np.fromiter(map(len, found), np.int64, len(found)))
            gc.freeze()  # what is remembered holds no cycles; the collector need not walk it again and again

    def encode_texts(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as chunks, joined, and the number of ids of each text."""
        flat = [c for t in texts for c in t]
        self._learn(flat)
        now = self.now
        at = np.fromiter(map(now.index.__getitem__, flat), np.int64, len(flat))
        length = now.lengths[at]
        before = np.append(0, np.cumsum(length))
        cuts = np.cumsum([0, *map(len, texts)])
        return ragged_take(now.ids, now.starts[at], length), np.diff(before[cuts])
