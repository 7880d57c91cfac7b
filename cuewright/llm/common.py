"""What several operators of this subpackage share: the shared folder, Arrow slices, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.session import hadoop_path, remove_at_exit, shared_path, ship_package

#: Bytes of text that one numpy step works on; a longer text is one slice of its own.
SLICE_BYTES = 1 << 20

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows and bytes of an Arrow batch, in place of Spark's default of 10,000 rows, which may be long texts.
ARROW_ROWS, ARROW_BYTES = "1000", "2m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where the session leaves them at their defaults, Arrow batches are made small."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While this lasts, a finished query's shuffle files go at once, not when the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts lineage).

    The table stays until ``discard`` or, where a lazy result reads it, until the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        files, at = hadoop_path(table.sparkSession, table._scratch)
        files.delete(at, True)


#: Bits of a mark table and of one of its rows (Spark's bitmap functions), and its size: 64 MB at most.
BITMAP_BITS, LEAST_BITS, MOST_BITS = 32768, 1 << 20, 1 << 29


def spare_names(taken: list[str], n: int) -> list[str]:
    """``n`` column names that are not taken."""
    low = {c.lower() for c in taken}
    return [x for x in (f"__own_{i}" for i in range(len(taken) + n)) if x not in low][:n]


def perhaps_in(df: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: false where the hash ``key`` is surely none of ``wanted`` (one bigint column).

    Without a shuffle of ``df``: the wanted keys set bits of a table of 16 bits a key, of 64 MB at most,
    which is broadcast. Beyond 33 million keys more rows pass by chance; callers join those that pass.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    group, at, found = spare_names([*df.columns, name], 3)
    place = F.pmod(wanted[0], F.lit(bits))
    marked = wanted.select(F.floor(place / BITMAP_BITS).alias(group), (place % BITMAP_BITS).alias("p"))
    marks = F.broadcast(marked.groupBy(group).agg(F.bitmap_construct_agg("p").alias(found)))
    place = F.pmod(key, F.lit(bits))
    rows = df.withColumns({group: F.floor(place / BITMAP_BITS), at: (place % BITMAP_BITS).cast("int")}).join(marks, group, "left")
    byte = F.conv(F.hex(F.expr(f"substring({found}, 1 + ({at} div 8), 1)")), 16, 10).cast("int")
    return rows.withColumn(name, F.coalesce(F.getbit(byte, F.col(at) % 8) == 1, F.lit(False))).drop(group, at, found)


def holdout_bucket(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; the remainder 2 is held out. Null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public domain), elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seed(i: int, odd: int) -> np.uint64:
    """The i-th multiple of an odd constant modulo 2**64, to set hash functions apart."""
    return np.uint64((i + 1) * odd % (1 << 64))


class WordCodes:
    """Cuts byte buffers into words and gives each word a 64-bit code, all in numpy.

    ``separators`` is a 256-entry boolean table. A word's code is a polynomial hash with a random
    value per byte, taken from prefix sums modulo 2**64 and finalised by ``mix64``.
    """

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self, separators: np.ndarray):
        self.separators = separators
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            base, inverse = np.full(n, self._BASE, np.uint64), np.full(n, pow(self._BASE, -1, 1 << 64), np.uint64)
            base[0] = inverse[0] = 1
            self.powers, self.inverses = np.cumprod(base), np.cumprod(inverse)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end (byte positions), row and code of every word, in order."""
        n = len(data)
        if not n:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        inside = ~self.separators[data]
        cut = np.zeros(n + 1, bool)  # a row begins here
        cut[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:n]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        row = np.searchsorted(offsets, start, "right") - 1
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        code = mix64((sums[end] - sums[start]) * self.inverses[start])
        return start, end, row, code


def ascii_space() -> np.ndarray:
    """Separators of the word pattern [^\\x20\\x09-\\x0D]+."""
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
