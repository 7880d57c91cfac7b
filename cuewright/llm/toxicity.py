"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams (3 to 5 code points) of the ASCII-lower-cased whole
text, hashed to 2**18 places. On the training rows each feature has its log-count ratio between toxic and other
documents; features whose chi-square passes a Bonferroni-corrected level are kept, their values are
the ratios, and logistic regression with an L2 penalty on them gives the score. Scoring is one pass
with a table lookup per n-gram.

The classifier is fitted on a bounded sample of the labelled rows (``most_toxic`` and
``most_other``, drawn by a hash of the id); class weights restore the true share. Near copies (texts
with the same least 5-word shingle) count once between them.

Defined results: null and empty texts have the score of a text without any feature. Label rows that
are null, or whose documents are missing, teach nothing; of several labels for one id the largest
counts, of several texts the least. Without both classes the score is the share of toxic labels. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import WordCodes, ascii_lower, ascii_space, byte_slices, discard, holdout_bucket, mix64, shuffles_removed, text_buffer, written
from cuewright.llm.near_dedup import shingle_sets

PLACES = 1 << 18
ORDERS = (3, 4, 5)
#: Bytes of text at a time while all n-grams are kept apart.
TRAIN_SLICE = 256 << 10
#: Chi-square with one degree of freedom at 0.01 / PLACES.
LEAST_CHI = 29.4


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) and row offsets in them, of UTF-8 bytes and row offsets in those."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.uint32)
    if len(at) == len(data):
        return code, offsets
    size = 1 + (code >= 0xC0) + (code >= 0xE0) + (code >= 0xF0)
    code = np.where(size == 1, code, code & (np.uint32(0x7F) >> size.astype(np.uint32)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        code[more] = (code[more] << np.uint32(6)) | (data[at[more] + k] & np.uint8(0x3F))
    return code, np.searchsorted(at, offsets)


def _grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """n and the hashed place of the n-gram at each character."""
    whole = np.zeros(len(data), np.uint32)
    for j in range(max(ORDERS)):
        n = j + 1
        if len(data) < n:
            return
        whole = whole[: len(data) - j] * np.uint32(0x01000193) + (data[j:] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            yield n, (((whole ^ (whole >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(14)).astype(np.int32)


def _hits(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs; features are places, or what ``table`` has for them (-1: none)."""
    rows, features = [], []
    codes, offsets = characters(ascii_lower(data), offsets)
    for n, place in _grams(codes):
        if table is None:
            at, feature = np.arange(len(place)), place
        else:
            feature = table[place]
            at = np.flatnonzero(feature >= 0)
            feature = feature[at]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[row + 1]
        rows.append(row[inside])
        features.append(feature[inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(rows) * PLACES + np.concatenate(features))
    return both // PLACES, both % PLACES


@dataclass
class ToxicityModel:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.full(PLACES, -1, np.int32)
        table[self.places] = np.arange(len(self.places))
        return table

    def score(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
        row, feature = _hits(data, offsets, table)
        z = self.bias + np.bincount(row, self.weights[feature], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(features: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, places: np.ndarray, ratio: np.ndarray, penalty: float = 2.0, steps: int = 400) -> ToxicityModel:
    """Logistic regression on documents given as arrays of indexes into ``places``, whose values are ``ratio``."""
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
    if not len(places):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), bias)
    row = np.repeat(np.arange(len(features)), [len(c) for c in features])
    column, n = np.concatenate(features), weights.sum()
    value = ratio[column]
    w, b, m, v = np.zeros(len(places)), bias, np.zeros(len(places) + 1), np.zeros(len(places) + 1)
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = b + np.bincount(row, value * w[column], minlength=len(labels))
        gap = weights * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels)
        g = np.r_[np.bincount(column, value * gap[row], minlength=len(places)) + penalty * w, gap.sum()] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return ToxicityModel(places, w * ratio, float(b))


def _keys(data: np.ndarray, offsets: np.ndarray, codes: WordCodes) -> np.ndarray:
    """The least 5-word shingle of each text (0: no word): the same for most near copies."""
    row, shingle = shingle_sets(data, offsets, 5, codes)
    keys = np.full(len(offsets) - 1, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(keys, row, mix64(shingle))
    return keys.view(np.int64)


def _drawn(labelled: DataFrame, most: dict[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """Rows (id, label) below a hash threshold that leaves about ``most`` of each class, and the shares drawn."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    share = {k: min(1.0, most[k] / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return labelled.where(draw < limit), share


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 2000, most_other: int = 3000) -> ToxicityModel:
    """Fit on labelled rows that are not held out, ``most_toxic`` and ``most_other`` of them about."""
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    labelled = labelled.where(holdout_bucket(F.col("id")) != 2).groupBy("id").agg(F.max("label").alias("label"))
    drawn, share = _drawn(labelled, {1: most_toxic, 0: most_other})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(ascii_space())
        for batch in byte_slices(batches, "t", TRAIN_SLICE):
            data, offsets = text_buffer(batch.column(1))
            row, place = _hits(data, offsets, None)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found = [place[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_keys(data, offsets, codes)), pa.array(found, pa.binary())], ["label", "copy", "places"])

    # The sample of ids is bounded by its two parameters, so it is safe to broadcast, and so are its copies below.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "id")
    texts = texts.groupBy("id", "label").agg(F.min("t").alias("t")).select("label", "t")
    taken = rows = written(texts.mapInArrow(run, "label int, copy bigint, places binary"), "labelled")
    copies = rows.groupBy("copy").agg(F.count("*").alias("copies"))
    rows = rows.join(F.broadcast(copies), "copy").select("label", (1 / F.col("copies")).alias("weight"), "places")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, PLACES))
        for batch in batches:
            for label, weight, places in zip(*batch.columns):
                sums[label.as_py(), np.frombuffer(places.as_buffer(), "<i4")] += weight.as_py()  # a document's places are distinct
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[0, seen]), pa.array(sums[1, seen])], ["place", "other", "toxic"])

    n, p = rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.coalesce(F.sum(F.col("weight") * F.col("label")), F.lit(0.0))).first()
    kept: list = []
    if 0 < p < n:
        sums = rows.mapInArrow(counted, "place bigint, other double, toxic double").groupBy("place").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
        seen = F.col("other") + F.col("toxic")
        chi = n * F.pow(F.col("toxic") * n - seen * p, 2) / (p * (n - p) * seen * F.greatest(n - seen, F.lit(1e-9)))
        ratio = F.log((F.col("toxic") + 1) / (p + 1)) - F.log((F.col("other") + 1) / (n - p + 1))
        # Few places pass the corrected level; PLACES bounds them in any case.
        kept = sorted(sums.where((chi > LEAST_CHI) & (F.col("toxic") >= 2)).select("place", F.round(ratio, 9).alias("ratio")).collect())
    chosen = np.array([k.place for k in kept], np.int64)
    index = ToxicityModel(chosen, np.zeros(len(chosen)), 0.0).table()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [index[np.frombuffer(x.as_buffer(), "<i4")] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[x >= 0].astype("<i4").tobytes() for x in own], pa.binary())], ["label", "weight", "own"])

    with shuffles_removed(docs.sparkSession):
        found = sorted(rows.mapInArrow(reduced, "label int, weight double, own binary").collect(), key=lambda r: (r.own, r.label, r.weight))
    discard(taken)
    # Significance is judged on the sample itself; only the regression restores the classes' true shares.
    labels_of, weights = np.array([r.label for r in found], float), np.array([r.weight / share[r.label] for r in found], float)
    return fit([np.frombuffer(r.own, "<i4") for r in found], labels_of, weights, chosen, np.array([k.ratio for k in kept], float))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in byte_slices(batches, "t"):
            found = model.score(*text_buffer(batch.column(1)), table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) that score below ``limit``, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in byte_slices(batches, "text"):
            found = model.score(*text_buffer(batch.column(batch.schema.get_field_index("text"))), table)
            yield batch.filter(pa.array(found < limit))

    return docs.mapInArrow(run, docs.schema)
