"""Sharding by minimax contiguous partition. DataFrame operations only.

Rows with equal texts are one atomic group, of the sum of their sizes (UTF-8 bytes plus 1). Groups are
ordered by a 64-bit hash of the text and cut into ``shards`` contiguous runs so that the largest run
is as small as possible: the smallest feasible capacity is found by binary search, where a greedy pass
checks a capacity.

The search runs on a histogram of the ordered groups by the leading hash bits, at most a few thousand
rows whatever the input. It yields a capacity that certainly suffices (cuts between cells only) and
one below which no cut can go (cells cut anywhere). While the two differ, the cells in which a cut can
lie are split by further bits; it ends with the exact optimum over the groups. With that capacity the
cuts are placed as near to equal shares as it allows.

Law ``bytes``: sizes near equal. The slot of a row in its shard comes from counts of hashed cells and
a rank within the cell, so no shard is ever sorted in one task.

Defined results: null text counts as empty (size 1, crc 0) and shares the empty text's group. Repeated
rows have slots of their own; null ids are placed like others. An empty table gives no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import written

FIRST_BITS, MORE_BITS = 12, 6
SLOT_ROWS, MOST_SLOT_CELLS = 20_000, 4096


@dataclass(frozen=True)
class Cell:
    """The groups whose hash, shifted right by ``shift``, is ``key``."""

    key: int
    shift: int
    size: int
    groups: int

    @property
    def first_hash(self) -> int:
        return self.key << self.shift

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.shift == 0


class Cuts:
    """Greedy packing of ordered cells into ``shards`` runs."""

    def __init__(self, cells: list[Cell], shards: int):
        self.cells, self.shards, self.ends = cells, shards, [0]
        for cell in cells:
            self.ends.append(self.ends[-1] + cell.size)
        self.total = self.ends[-1]

    def _reach(self, start: int, capacity: int, anywhere: bool) -> int:
        end = min(self.total, start + capacity)
        i = bisect_right(self.ends, end) - 1
        return end if anywhere and i < len(self.cells) and not self.cells[i].atomic else self.ends[i]

    def feasible(self, capacity: int, anywhere: bool) -> bool:
        at = 0
        for _ in range(self.shards):
            at = self._reach(at, capacity, anywhere)
        return at == self.total

    def capacity(self, anywhere: bool) -> int:
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.feasible(middle, anywhere) else (middle + 1, high)
        return low

    def open_cells(self, least: int, most: int) -> list[Cell]:
        """The cells, not atomic, in which a cut can lie for a capacity between the two."""
        found, low, high = [], 0, 0
        for _ in range(self.shards - 1):
            low = self.ends[max(0, bisect_right(self.ends, min(self.total, low + least)) - 1)]
            high = min(self.total, high + most)
            first, last = max(0, bisect_right(self.ends, low) - 1), bisect_left(self.ends, high)
            found += self.cells[first:last]
        return [c for c in dict.fromkeys(found) if not c.atomic]

    def place(self, capacity: int) -> list[int]:
        """Ends (sizes before the cut) of the first shards: near equal shares, none above ``capacity``."""
        latest = [self.total]
        for _ in range(self.shards - 1):
            latest.append(self.ends[bisect_left(self.ends, latest[-1] - capacity)])
        out, at = [], 0
        for j in range(1, self.shards):
            low, high = max(at, latest[self.shards - j]), self.ends[bisect_right(self.ends, at + capacity) - 1]
            target = at + (self.total - at) / (self.shards - j + 1)
            i = bisect_left(self.ends, target)
            near = min((self.ends[x] for x in (i - 1, i) if 0 <= x < len(self.ends)), key=lambda e: abs(e - target))
            at = min(max(near, low), high)
            out.append(at)
        return out

    def hash_at(self, end: int) -> int | None:
        """The first hash at or after a cut; None behind the last group."""
        i = bisect_left(self.ends, end)
        return self.cells[i].first_hash if i < len(self.cells) else None


def _histogram(groups: DataFrame, shift: int, inside: list[Cell] | None = None) -> list[Cell]:
    if inside is not None:
        by_shift: dict[int, list[int]] = {}
        for c in inside:
            by_shift.setdefault(c.shift, []).append(c.key)
        test = F.lit(False)
        for s, keys in by_shift.items():
            test = test | F.shiftright("h", s).isin(keys)
        groups = groups.where(test)
    rows = groups.groupBy(F.shiftright("h", shift).alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"))
    return [Cell(r.key, shift, r["size"], r.groups) for r in rows.collect()]  # 2**12 cells, or 2**6 for each open one


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int | None], int]:
    """The hashes at which shards 1 and up begin, and the optimal capacity. ``groups`` has (h, size), one row per hash."""
    shift = 64 - FIRST_BITS
    cells = sorted(_histogram(groups, shift), key=lambda c: c.first_hash)
    while True:
        cuts = Cuts(cells, shards)
        most, least = cuts.capacity(anywhere=False), cuts.capacity(anywhere=True)
        opened = cuts.open_cells(least, most) if most > least else []
        if not opened:
            break
        split: list[Cell] = []
        for own in sorted({c.shift for c in opened}):
            split += _histogram(groups, max(0, own - MORE_BITS), [c for c in opened if c.shift == own])
        cells = sorted([c for c in cells if c not in set(opened)] + split, key=lambda c: c.first_hash)
    return [cuts.hash_at(end) for end in cuts.place(most)], most


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    base = written(base, "sizes")
    groups = written(base.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    starts, _ = minimax_cuts(groups, shards)
    shard: Column = F.lit(0)
    for start in starts:
        if start is not None:
            shard = shard + (F.col("h") >= F.lit(start)).cast("int")
    n = base.count()
    cells = max(1, min(MOST_SLOT_CELLS, n // SLOT_ROWS))
    rows = base.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("id", "h"), F.lit(cells)))
    sums = rows.groupBy("shard", "cell").agg(F.count("*").alias("c"))  # shards * cells rows at most
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "h", "size"))
    out = rows.withColumn("rank", rank).join(offsets, ["shard", "cell"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
