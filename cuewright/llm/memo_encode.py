"""Encoding whole texts with a tokenizer whose work falls apart at certain spaces.

Where no token spans a space, a text's ids are its pieces' ids in order. Distinct pieces are few
against all pieces, so each is encoded once per worker and looked up afterwards. The memory is
bounded: a table of ``most`` pieces takes up no more (pieces it lacks are encoded and forgotten), and
starts anew where it lacks more than half of what a slice of texts holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: pieces -> (all their ids, how many each has)
EncodePieces = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: texts -> list of pieces for each, in order
CutTexts = Callable[[pa.Array], pa.ListArray]


class MemoEncoder:
    def __init__(self, cut: CutTexts, encode: EncodePieces, most: int = 1_000_000):
        self.cut, self.encode_pieces, self.most = cut, encode, most
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # of slot i - 1, at i
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        for first in range(0, len(pieces), 2000):
            part = pieces[first : first + 2000]
            ids, counts = self.encode_pieces(part)
            n, start = len(self.slots), self.used
            while start + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ids[start : start + len(ids)] = ids
            self.used += len(ids)
            self.ends[n + 1 : n + 1 + len(part)] = start + np.cumsum(counts)
            self.slots.update(zip(part, range(n, n + len(part))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the offsets (n + 1) of each text's ids."""
        lists = self.cut(texts.fill_null(""))
        pieces = lists.flatten().dictionary_encode()
        own = pieces.dictionary.to_pylist()
        fresh = [p for p in own if p not in self.slots]
        full = len(self.slots) + len(fresh) > self.most
        if full and 2 * len(fresh) > len(own):
            self._reset()
            fresh, full = own, len(own) > self.most
        slots, used = self.slots, self.used
        if fresh:
            self._learn(fresh)
        slot = np.fromiter((slots[p] for p in own), np.int64, len(own))
        start, count = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        at = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = count[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        ids = self.ids[np.repeat(start[at] - ends[:-1], counts) + np.arange(ends[-1])]
        if full:
            for p in fresh:
                del slots[p]
            self.used = used
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        rows = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=rows[1:])
        return ids, ends[rows]
