"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Texts are sequences of words (runs of letters, digits and non-ASCII characters of the lower-cased
text). A document is contaminated by an item of n words if some stretch of it is within
floor(``share`` * n) word edits (insert, delete, replace) of the item. Steps, in one pass over the
documents without a shuffle:

1. windows: each item is as long as its windows. A stretch within k edits of n words keeps at least
   one run of q words wherever n - q + 1 > q * k, so the windows that begin where such a run places
   the item's start are all that can match; nothing is lost here.
2. CGK: a random walk copies a window to 3n places, stepping on after a word by a random bit of the
   place and word. Edit distance becomes Hamming distance. Keys sample ``bits`` places; a window goes
   on if any of its keys is the item's. How many walks are used is found by simulating items with the
   most edits allowed until ``recall`` of them share a key; where ``MOST_WALKS`` do not reach that, all
   windows go on.
3. verification: exact edit distance between the item and the best stretch around the window.

The items are a stated query set: they are sent to the executors in blocks of at most
``block_bytes`` of text, one pass over the documents for each block.

Defined results: null and empty texts and items without words match nothing. One row for each
document row and item, with the smallest distance and its first place. A null document id is
reported as null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import WordCodes, byte_slices, mix64, seed, text_buffer

SAMPLINGS = 16
MOST_WALKS = 24
#: Places of walks held at a time, and simulated in all.
CELLS, SIMULATED_CELLS = 1 << 22, 1 << 27


def plain_words() -> np.ndarray:
    """Separators: every ASCII byte but letters and digits."""
    table = np.ones(256, bool)
    table[128:] = False
    for first, last in ("09", "az", "AZ"):
        table[ord(first) : ord(last) + 1] = False
    return table


def word_codes(texts: pa.Array, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every word."""
    _, _, row, code = codes.words(*text_buffer(pc.utf8_lower(texts)))
    return row, code


def run_length(n: int, k: int) -> int:
    """The longest of 3, 2, 1 words of which a run survives k edits in n words."""
    return next((q for q in (3, 2) if n - q + 1 > q * k and n >= q), 1)


def _runs(code: np.ndarray, q: int) -> np.ndarray:
    total = np.zeros(max(0, len(code) - q + 1), np.uint64)
    for j in range(q):
        total += mix64(code[j : j + len(total)] + seed(j, 0xE7037ED1A0B428DB))
    return mix64(total)


@dataclass
class Items:
    """A block of items and their embeddings' keys."""

    ids: list[int]
    codes: list[np.ndarray]
    share: float = 0.2
    bits: int = 2
    recall: float = 0.999

    def __post_init__(self) -> None:
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.floor(self.size * self.share + 1e-9).astype(np.int64)
        self.by_run: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        runs: dict[int, list] = {}
        for i, (code, k) in enumerate(zip(self.codes, self.edits)):
            if len(code):
                q = run_length(len(code), int(k))
                found = _runs(code, q)
                runs.setdefault(q, []).append((found, np.full(len(found), i), np.arange(len(found))))
        for q, parts in runs.items():
            run, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(run, kind="stable")
            self.by_run[q] = run[order], item[order], place[order]
        self.flat = np.concatenate([*self.codes, np.zeros(0, np.uint64)]).astype(np.uint64)
        self.offset = np.r_[0, np.cumsum(self.size)][:-1]
        own = np.arange(len(self.codes))
        ends = self.offset + self.size
        self.keys = self.embed(self.flat, self.offset, self.offset, ends, own, MOST_WALKS, pad=1)
        self.walks = self._needed()
        self.keys = self.keys[:, : (self.walks or 0) * SAMPLINGS]

    def embed(self, code: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, walks: int, pad: int = 0) -> np.ndarray:
        """[windows, walks * SAMPLINGS] keys of windows of ``code``, each from its start over its item's size.

        Places outside a window's row (``low`` to ``high``) count as one word. Items and windows have
        different padding, so the ends of two walks are no agreement. Windows are taken by size, as many
        at a time as fit ``CELLS`` places, so a very long one stands alone.
        """
        keys = np.zeros((len(start), walks, SAMPLINGS), np.uint64)
        order = np.argsort(self.size[item], kind="stable")
        order = order[self.size[item[order]] > 0]
        done = 0
        while done < len(order):
            sizes = self.size[item[order[done:]]]
            fits = np.arange(1, len(sizes) + 1) * sizes * (3 * walks) <= CELLS
            taken = order[done : done + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))]
            done += len(taken)
            keys[taken] = self._walk(code, start[taken], low[taken], high[taken], self.size[item[taken]], walks, pad)
        return keys.reshape(len(start), walks * SAMPLINGS)

    def _walk(self, code: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, walks: int, pad: int) -> np.ndarray:
        """All walks of some windows side by side: [windows, walks, SAMPLINGS] keys."""
        turn = np.arange(walks)
        at = np.zeros((len(start), walks), np.int64)
        copied = np.zeros((3 * int(n.max()), len(start), walks), np.uint64)
        start, low, high, size = start[:, None], low[:, None], high[:, None], n[:, None]
        for step in range(len(copied)):
            inside, place = at < size, start + at
            known = inside & (place >= low) & (place < high)
            symbol = np.where(known, code[np.clip(place, 0, max(0, len(code) - 1))], np.where(inside, np.uint64(0), np.uint64(pad)))
            copied[step] = symbol
            coin = (symbol ^ (symbol >> np.uint64(29))) * ((step + 1009 * turn + 1).astype(np.uint64) * np.uint64(0xEB44ACCAB455D165))
            at += inside & (coin >> np.uint64(63)).astype(bool)
        keys = np.zeros((len(at), walks, SAMPLINGS), np.uint64)
        rows = np.arange(len(at))[:, None]
        for walk in range(walks):
            # For each size, walk and sampling: which of the 3n places are sampled.
            pick = mix64(np.arange(SAMPLINGS * self.bits, dtype=np.uint64) + seed(walk, 0x1D8E4E27C47D124F)).reshape(SAMPLINGS, self.bits)
            wanted = (pick[None] % (3 * n.astype(np.uint64))[:, None, None]).astype(np.int64)
            for b in range(self.bits):
                place = wanted[:, :, b]
                keys[:, walk] += mix64(copied[place, rows, walk] + seed(b, 0x589965CC75374CC3) + place.astype(np.uint64))
        return keys

    def _needed(self) -> int | None:
        """Walks with which ``recall`` of items with the most edits allowed share a key; None if ``MOST_WALKS`` do not
        reach it, and every window is verified."""
        random = np.random.default_rng(5)
        full = np.flatnonzero(self.size)
        if not len(full):
            return 1
        item = np.resize(random.permutation(full), 400)
        cells = np.cumsum(self.size[item]) * (3 * MOST_WALKS)
        item = item[: max(40, int((cells <= SIMULATED_CELLS).sum()))]
        windows = []
        for i in item:
            words, n = self.codes[i].tolist(), int(self.size[i])
            for _ in range(int(self.edits[i])):
                kind, p = random.integers(3), int(random.integers(max(1, len(words))))
                new = int(random.integers(1, 1 << 62))
                words[p : p + int(kind > 0)] = [new] * int(kind < 2)
            windows.append(np.array((words + [int(x) for x in random.integers(1, 1 << 62, n)])[:n], np.uint64))
        at = np.r_[0, np.cumsum(self.size[item])]
        keys = self.embed(np.concatenate(windows), at[:-1], at[:-1], at[1:], item, MOST_WALKS)
        same = (keys == self.keys[item]).reshape(len(item), MOST_WALKS, SAMPLINGS).any(axis=2)
        found = np.maximum.accumulate(same, axis=1).mean(axis=0)
        return int(np.argmax(found >= self.recall)) + 1 if (found >= self.recall).any() else None

    def marks(self) -> dict[int, np.ndarray]:
        """By run length, a table of the top 16 bits that the items' runs have."""
        out = {}
        for q, (run, _, _) in self.by_run.items():
            out[q] = np.zeros(1 << 16, bool)
            out[q][(run >> np.uint64(48)).astype(np.int64)] = True
        return out

    def windows(self, row: np.ndarray, code: np.ndarray, marks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start, item) of the windows that a shared run of words proposes; starts may lie outside the row."""
        starts, items = [], []
        for q, (run, item, place) in self.by_run.items():
            own = _runs(code, q)
            at = np.flatnonzero(marks[q][(own >> np.uint64(48)).astype(np.int64)])
            at = at[row[at] == row[at + q - 1]]
            first, last = np.searchsorted(run, own[at], "left"), np.searchsorted(run, own[at], "right")
            count = last - first
            posting = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            starts.append(np.repeat(at, count) - place[posting])
            items.append(item[posting] + np.int64(0) + (row[np.repeat(at, count)] * len(self.ids)))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)]), axis=1)
        return both[1], both[0]

    def hits(self, row: np.ndarray, code: np.ndarray, marks: dict[int, np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(row, item, edit distance, first word of the window in its row) of every contaminated row and item."""
        start, both = self.windows(row, code, marks)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        first = np.searchsorted(row, np.arange(row[-1] + 2)) if len(row) else np.zeros(1, np.int64)
        for a in range(0, len(start), 4096):
            s, r, i = start[a : a + 4096], both[a : a + 4096] // len(self.ids), both[a : a + 4096] % len(self.ids)
            lo, hi = first[r], first[r + 1]
            passed = np.arange(len(s))
            if self.walks:
                passed = np.flatnonzero((self.embed(code, s, lo, hi, i, self.walks) == self.keys[i]).any(axis=1))
            for x in passed:
                n, k = int(self.size[i[x]]), int(self.edits[i[x]])
                p, e = max(int(lo[x]), int(s[x]) - k), min(int(hi[x]), int(s[x]) + n + k)
                found = stretch_distance(self.codes[i[x]], code[p:e])
                if found <= k:
                    key, value = (int(r[x]), int(i[x])), (found, max(0, int(s[x] - lo[x])))
                    best[key] = min(best.get(key, value), value)
        return [(*k, *v) for k, v in sorted(best.items())]


def stretch_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least number of word edits between ``item`` and any stretch of ``text``."""
    steps = np.arange(len(text) + 1)
    line, below = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item):
        below[0] = i + 1
        np.minimum(line[1:] + 1, line[:-1] + (text != word), out=below[1:])
        below -= steps
        np.minimum.accumulate(below, out=line)
        line += steps
    return int(line.min())


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20, **options) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes`` of text."""
    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    codes = WordCodes(plain_words())
    for b in range(blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect(), key=lambda r: (r.id is None, r.id, r.t))
        row, code = word_codes(pa.array([r.t for r in rows], pa.string()), codes)
        ends = np.searchsorted(row, np.arange(len(rows) + 1))
        yield Items([r.id for r in rows], [code[x:y] for x, y in zip(ends[:-1], ends[1:])], **options)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col``, item_id, item_words, edit_distance, first_word: a row for each document and item it holds."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = None
    for items in item_blocks(benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            codes, marks = WordCodes(plain_words()), items.marks()
            for batch in byte_slices(batches, "t"):
                found = items.hits(*word_codes(batch.column(1), codes), marks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))]
                    + [pa.array(v, pa.int64()) for v in ([items.ids[f[1]] for f in found], [int(items.size[f[1]]) for f in found], [f[2] for f in found], [f[3] for f in found])],
                    ["id", "item_id", "item_words", "edit_distance", "first_word"],
                )

        part = rows.mapInArrow(run, f"id {kind}, item_id bigint, item_words bigint, edit_distance bigint, first_word bigint")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def clean_rows(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that keeps the rows (with all their columns) without any item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, marks = WordCodes(plain_words()), items.marks()
        for batch in byte_slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = np.ones(batch.num_rows, bool)
            keep[[h[0] for h in items.hits(*word_codes(texts, codes), marks)]] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) that hold no benchmark item, all columns kept."""
    for items in item_blocks(benchmark, **options):
        docs = docs.mapInArrow(clean_rows(items), docs.schema)
    return docs
