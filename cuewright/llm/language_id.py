"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is a vector of hashed byte n-grams (2 and 3) of its lower-cased words: 1 + log of the count,
times the inverse document frequency, scaled to length one. Each language has several centroids
(spherical k-means with farthest-point starts over its training vectors). A text gets the language of
the centroid with the largest cosine; ``rejected`` is set where the distance to it is beyond what the
centroid's training members show (``reject_quantile`` of their distances, plus ``reject_margin``).

Fitted on at most about ``most`` rows, shared evenly between languages, drawn by a hash of the id
among rows that are not held out. Everything else covers all rows and whole texts.

Defined results: null text, or text without a letter, is ``und`` with score 0 and rejected. Where
nothing could be learned everything is ``und``. Null languages teach nothing. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import byte_slices, holdout_bucket, text_buffer

PLACES = 4096
ROWS = 256
UNKNOWN = "und"
MOST_BROADCAST = 10_000


def _counts(texts: pa.Array) -> np.ndarray:
    """[rows, PLACES] counts of hashed n-grams; white space, digits and marks count as one blank."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    n = len(offsets) - 1
    letters = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letters, data, np.uint8(32)).astype(np.uint32)
    total = np.zeros(n * PLACES, np.float32)
    row = np.repeat(np.arange(n) * PLACES, np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes from here to the row's end
    for k in (2, 3):
        if len(data) < k:
            break
        m = len(data) - k + 1
        code = data[:m] * np.uint32(0x10001) + data[1 : m + 1] * np.uint32(0x101)
        if k == 3:
            code = code * np.uint32(31) + data[2 : m + 2]
        place = ((code * np.uint32(0x9E3779B1 + 2 * k)) >> np.uint32(20)).astype(np.int64)
        use = (last[:m] >= k) & ((data[:m] != 32) | (data[1 : m + 1] != 32))
        total += np.bincount(row[:m][use] + place[use], minlength=n * PLACES).astype(np.float32)
    return total.reshape(n, PLACES)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "t"):
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # least cosine of each centroid

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = _unit(np.log1p(_counts(texts)) * self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(best)), best].astype(np.float64)
        return [self.languages[i] for i in best], np.clip(top, 0, 1), top < self.limits[best]


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at the mean's nearest vector, then at the farthest ones."""
    k = min(k, len(x))
    mean = _unit(x.mean(axis=0, keepdims=True))
    c = x[[int((x @ mean.T).argmax())]]
    while len(c) < k:
        c = np.vstack([c, x[[int((x @ c.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.vstack([_unit(x[own == i].mean(axis=0, keepdims=True)) if (own == i).any() else c[[i]] for i in range(k)])
    return c


def fit(counts: np.ndarray, languages: list[str], k: int = 4, reject_quantile: float = 0.002, reject_margin: float = 0.1) -> LanguageModel:
    if not len(counts):
        return LanguageModel([], np.zeros((0, PLACES)), np.zeros(PLACES), np.zeros(0))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    names, centres, limits = [], [], []
    for name in sorted(set(languages)):
        own = x[[i for i, v in enumerate(languages) if v == name]]
        c = _centroids(own, k)
        top, at = (own @ c.T).max(axis=1), (own @ c.T).argmax(axis=1)
        names += [name] * len(c)
        centres.append(c)
        limits += [float(np.quantile(top[at == i] if (at == i).any() else top, reject_quantile)) - reject_margin for i in range(len(c))]
    return LanguageModel(names, np.vstack(centres).astype(np.float32), idf, np.array(limits))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 2400, k: int = 4) -> LanguageModel:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("id is not null and l is not null and t is not null")
    rows = rows.where(holdout_bucket(F.col("id")) != 2)
    known = rows.groupBy("l").count()
    size = known.agg(F.count("*").alias("k")).first().k
    limit = F.least(F.lit(1.0), F.lit(most / max(size, 1)) / F.col("count"))
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    limits = known.select("l", limit.alias("limit"))
    # One row per language: sent to the texts where they are checked to be few, joined by shuffling otherwise.
    limits = F.broadcast(limits) if size <= MOST_BROADCAST else limits
    # One row an id (the least text), so the bound on drawn ids bounds what is collected.
    sample = rows.join(limits, "l").where(draw < F.col("limit")).groupBy("id", "l").agg(F.min("t").alias("t")).select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            found = [row.astype("<f4").tobytes() for row in _counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["l", "c"])

    found = sorted(((r.l, r.c) for r in sample.mapInArrow(run, "l string, c binary").collect()))
    return fit(np.array([np.frombuffer(c, "<f4") for _, c in found], np.float32).reshape(-1, PLACES), [name for name, _ in found], k)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score (cosine, 0 to 1), rejected."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            names, top, far = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(top), pa.array(far)], ["id", "letter", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), letter.alias("letter"))
    found = rows.mapInArrow(run, f"id {kind}, letter boolean, lang_pred string, score double, rejected boolean")
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"),
        (F.col("rejected") | ~F.col("letter")).alias("rejected"),
    )
