"""Token-id files: one concatenated id array per block with Elias-Fano document boundaries.

A dataset is a folder of files in ascending document-id order; a file is a run of blocks, each:

    magic "CWTOKEF1" | header (little-endian, ``HEADER``) | ids | boundaries | document ids
    | null flags | 0x0A

ids take 2 bytes each where all fit, else 4. The n + 1 boundaries are stored by Elias-Fano coding
(low bits packed, high bits unary) with a sampled select structure: the place of every 256th set
bit. A boundary is found from one sample and a short scan, in about 2 + log2(ids / documents) bits a
document instead of a 64-bit table. Document ids are stored likewise as distances from the smallest.

Files are written by Spark's own text writer (a block's bytes are one "line", so any Hadoop file
system works and a lost executor's attempt is discarded by the commit protocol) and read back by the
binaryFile source.

Defined results: null text is empty, so it has the end id only. Null ids come first and stay null;
equal ids follow each other in order of their ids' bytes. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.common import byte_slices, shuffles_removed, written
from cuewright.llm.memo_encode import MemoEncoder
from cuewright.session import remove_at_exit, shared_path

MAGIC = b"CWTOKEF1"
#: part, block, documents, ids, bytes of an id, smallest document id, and for boundaries and
#: document ids: low bits, bytes of the low and high parts, number of samples.
HEADER = struct.Struct("<QQQQQq4Q4Q")
SAMPLE = 256
BLOCK_IDS = 2 << 20
#: Text of an id range, and how many ranges at most; larger ranges make more files, not larger ones.
PART_BYTES, MOST_PARTS = 24 << 20, 20_000
FILE_BLOCKS = 4
CELLS = 1 << 16
PARTS_A_GROUP = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little") if low_bits else np.zeros(0, np.uint8)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        bits[place] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), place[::SAMPLE].astype("<u4"))

    def sizes(self) -> tuple[int, int, int, int]:
        return self.low_bits, len(self.low), len(self.high), len(self.samples)

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: np.ndarray, at: int, n: int, sizes: tuple[int, int, int, int]) -> tuple[EliasFano, int]:
        low_bits, low, high, samples = sizes
        ends = np.cumsum([at, low, high, 4 * samples])
        parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        return cls(n, low_bits, parts[0], parts[1], np.frombuffer(parts[2].tobytes(), "<u4")), int(ends[-1])

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, ones = place // 8, 0
        skip = int(self.high[byte]) & (0xFF >> (8 - place % 8) if place % 8 else 0)
        want = rest + skip.bit_count()
        while ones + (count := int(self.high[byte]).bit_count()) <= want:
            ones, byte = ones + count, byte + 1
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[want - ones])
        return (place - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def select_many(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last`` - 1: the high bits from one sample to the next, 256 values at a time."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        places = np.zeros(last - first, np.int64)
        for group in range(first // SAMPLE, -(-last // SAMPLE) if last > first else 0):
            begin = int(self.samples[group])
            stop = int(self.samples[group + 1]) if group + 1 < len(self.samples) else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-stop // 8)], bitorder="little")) + begin // 8 * 8
            ones = ones[(ones >= begin) & (ones < stop)]
            a, b = max(first, group * SAMPLE), min(last, (group + 1) * SAMPLE)
            places[a - first : b - first] = ones[a - group * SAMPLE : b - group * SAMPLE]
        return (((places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(first, last)).astype(np.int64)


def pack_block(part: int, block: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    null = np.array([d is None for d in doc_ids], bool)
    least = min((d for d in doc_ids if d is not None), default=0)
    bounds = EliasFano.encode(np.r_[0, np.cumsum(counts)])
    names = EliasFano.encode(np.array([0 if d is None else d - least for d in doc_ids], np.uint64))
    head = HEADER.pack(part, block, len(doc_ids), len(ids), width, least, *bounds.sizes(), *names.sizes())
    return b"".join([MAGIC, head, ids.astype(f"<u{width}").tobytes(), bounds.tobytes(), names.tobytes(), np.packbits(null).tobytes()])


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], EliasFano, np.ndarray]]:
    """part, block, document ids, boundaries (n + 1, to select from) and ids of every block of a file."""
    data, at = np.frombuffer(content, np.uint8), 0
    while at < len(data):
        if content[at : at + len(MAGIC)] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += len(MAGIC)
        part, block, n, n_ids, width, least, *sizes = HEADER.unpack(content[at : at + HEADER.size])
        at += HEADER.size
        ids = np.frombuffer(content[at : at + width * n_ids], f"<u{width}")
        bounds, at = EliasFano.read(data, at + width * n_ids, n + 1, tuple(sizes[:4]))
        names, at = EliasFano.read(data, at, n, tuple(sizes[4:]))
        null = np.unpackbits(data[at : at + -(-n // 8)])[:n]
        at += -(-n // 8) + 1
        doc_ids = [None if x else int(d) + least for d, x in zip(names.select_many(0, n).tolist(), null.tolist())]
        yield part, block, doc_ids, bounds, ids


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_SHARED: dict[str, tuple] = {}  # per worker and tokenizer file: what was encoded once


class WordBpe:
    """Encodes with a tokenizers file whose pre-tokenizer drops white space, so texts fall apart there.

    A piece of plain letters, with or without punctuation behind it, is one or two pre-tokens that no
    normaliser but lower-casing changes; such pieces go to the library's model directly and all
    others through its whole pipeline.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.!?;:#$%&*|]*)")

    def __init__(self, path: str):
        self.path = path

    def _start(self) -> tuple:
        tokenizer = _load(self.path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        letters = {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(others)}  # byte-level alphabet
        model, marks = tokenizer.model, {"": []}

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found: list[list[int] | None] = []
            hard: list[int] = []
            for i, piece in enumerate(pieces):
                if m := self.PLAIN.fullmatch(piece):
                    word, mark = m.groups()
                    word = word.lower()
                    if not word.isascii():
                        word = "".join(map(letters.__getitem__, word.encode()))
                    if mark not in marks:
                        marks[mark] = tokenizer.encode(mark, add_special_tokens=False).ids
                    found.append([t.id for t in model.tokenize(word)] + marks[mark])
                else:
                    found.append(None)
                    hard.append(i)
            if hard:
                whole = tokenizer.encode([pieces[i] for i in hard], is_pretokenized=True, add_special_tokens=False)
                for i in hard:
                    found[i] = []
                for at, x in zip(whole.word_ids, whole.ids):
                    found[hard[at]].append(x)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((x for ids in found for x in ids), np.uint32, int(counts.sum())), counts

        return tokenizer, MemoEncoder(pc.ascii_split_whitespace, encode)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.path not in _SHARED:
            _SHARED[self.path] = self._start()
        return _SHARED[self.path][1](texts)


Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def range_edges(ids: DataFrame, parts: int) -> np.ndarray:
    """Ascending values that cut ``id`` into at most ``parts`` ranges of about equal numbers of rows.

    Rows are counted by the leading bits of their ids, in at most ``CELLS`` cells, and cells with more than
    two ranges' rows by four more bits, again and again; counts are combined before they are shuffled.
    """
    known = ids.where("id is not null")
    low, high, n = known.agg(F.min("id"), F.max("id"), F.count("*")).first()
    if parts < 2 or not n:
        return np.zeros(0, np.int64)
    shift = next(s for s in range(64) if (high >> s) - (low >> s) < CELLS)
    target, leaves, split = n / parts, [], None
    while True:
        cell = F.shiftright("id", shift).alias("cell")
        rows = known.select(cell, "id") if split is None else known.select(cell, "id", F.shiftright("id", shift + 4).alias("over")).join(F.broadcast(split), "over")
        found = [(r["cell"], r["count"]) for r in rows.groupBy("cell").count().collect()]
        heavy = [c for c, k in found if k > 2 * target and shift > 3]  # fewer than half as many as ranges
        leaves += [(c << shift, k) for c, k in found if k <= 2 * target or shift <= 3]
        if not heavy:
            break
        shift, split = shift - 4, ids.sparkSession.createDataFrame([(c,) for c in heavy], "over long")
    edges, behind = [], 0
    for first, k in sorted(leaves):
        if behind >= target * (len(edges) + 1) and len(edges) < parts - 1:
            edges.append(first)
        behind += k
    return np.array(edges, np.int64)


def write_token_files(docs: DataFrame, path: str, encoder: Encoder, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the files at ``path`` in ascending id order.

    Texts are encoded where they are read and only ids are shuffled. Range bounds come from
    ``range_edges``, at most ``MOST_PARTS`` values.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    total, = docs.agg(F.sum(F.octet_length("t"))).first()
    parts = max(1, min(MOST_PARTS, -(-(total or 0) // PART_BYTES)))
    edges = range_edges(docs.select("id"), parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "t", 8 << 20):
            ids, ends = encoder(batch.column(1))
            ends_with = ends + np.arange(len(ends))
            whole = np.full(ends_with[-1], end_id, np.uint32)
            place = np.ones(len(whole), bool)
            place[ends_with[1:] - 1] = False
            whole[place] = ids
            small = len(whole) == 0 or int(whole.max()) < 1 << 16
            data = whole.astype("<u2" if small else "<u4").tobytes()
            scale = 2 if small else 4
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((ends_with * scale).astype(np.int64)), pa.py_buffer(data)])
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            part = np.where(known, np.searchsorted(edges, batch.column(0).fill_null(0).to_numpy(), "right"), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, scale, np.int32)), column.cast(pa.binary()), pa.array(part.astype(np.int32))], ["id", "width", "ids", "part"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, np.ndarray]] = []
        size, block, part = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, size, block
            data = pack_block(part, block, [d for d, _ in waiting], np.array([len(x) for _, x in waiting], np.int64), np.concatenate([x for _, x in waiting]))
            waiting, size, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in batches:
            for doc, width, ids, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part = own
                waiting.append((doc, np.frombuffer(ids, f"<u{width}").astype(np.uint32)))
                size += len(waiting[-1][1])
                if size >= BLOCK_IDS:
                    yield flush()
        if waiting:
            yield flush()

    encoded = docs.mapInArrow(encode, "id bigint, width int, ids binary, part int")
    placed = encoded.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "ids")
    blocks = placed.mapInArrow(pack, "data binary")
    blocks.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(path, lineSep="\n")


def read_token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, block, doc_ids, bounds, ids in read_blocks(content.as_py()):
                    view = memoryview(ids.astype("<u4").tobytes())
                    at = bounds.select_many(0, bounds.n)
                    ends = at.tolist()
                    sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
                    n = len(doc_ids)
                    columns = [pa.array(doc_ids, pa.int64()), pa.array(np.full(n, part)), pa.array(np.full(n, block)), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "block", "local", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    found = written(files.mapInArrow(digest, "doc_id bigint, part bigint, block bigint, local bigint, n_tokens bigint, ids_crc32 bigint"), "digest")
    # Prefix sums in two steps, over groups of id ranges and within a group, so that no task sees every block.
    group = F.floor(F.col("part") / PARTS_A_GROUP).alias("group")
    sums = found.groupBy("part", "block").agg(F.sum("n_tokens").alias("s")).select("*", group)  # a row per block
    behind = lambda w: F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("group").agg(F.sum("s").alias("s")).select("group", behind(Window.orderBy("group")).alias("before"))
    base = sums.select("group", "part", "block", behind(Window.partitionBy("group").orderBy("part", "block")).alias("within"))
    base = base.join(groups, "group").select("part", "block", (F.col("before") + F.col("within")).alias("base"))
    return found.join(base, ["part", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, encoder: Encoder, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files (in the shared folder unless ``path`` is given) and return their digest."""
    spark = docs.sparkSession
    own = path is None
    path = path or shared_path(spark, "tokens")
    with shuffles_removed(spark):
        write_token_files(docs, path, encoder, end_id, id_col, text_col)
    if own:
        remove_at_exit(spark, path)
    return read_token_digest(spark, path)
