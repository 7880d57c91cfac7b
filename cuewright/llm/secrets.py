"""Secret scans: pattern spans, and a character convolutional network over every candidate.

Three base patterns (``BASE``) give spans that always stay. Other candidates are runs of token
characters, 16 or more with a digit and a letter; of a run that base spans overlap, each stretch of
16 or more characters that they leave. Every candidate, base or
not, is scored by a small convolutional network in numpy over its characters and those around it; one
longer than ``INSIDE`` characters is scored in overlapping windows over its whole length, of that
size and of half of it, and has the largest of their scores. A candidate outside the base becomes a
span of kind ``cnn`` if its calibrated score reaches the threshold.

The network is trained on labelled findings (``labelled_findings``: generated keys and harmless
strings in prose and code contexts, a fixed number with a fixed seed). A held-out third of them
calibrates its logits (Platt scaling) and sets the threshold: the largest whose lower 95 % bound of
recall is at least ``recall``.

Defined results: null text is empty. Offsets are code points, ends exclusive. A text without spans
has counts 0, an empty ``spans`` and the hash of an empty string. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import ascii_lower, byte_slices, text_buffer

#: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = [b[0] for b in BASE] + ["cnn"]
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TOKEN_BYTES = np.isin(np.arange(256), np.frombuffer((string.ascii_letters + string.digits + "+/_=-").encode(), np.uint8))
DIGIT_BYTES = np.isin(np.arange(256), np.frombuffer(string.digits.encode(), np.uint8))
BEFORE, INSIDE, AFTER = 24, 40, 8
LENGTH = BEFORE + INSIDE + AFTER
#: Windows that are encoded and scored at once, however long a candidate is.
WINDOWS = 1024

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base, by start and kind."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def other_candidates(text: str, base: list[Span]) -> list[Span]:
    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            at = m.start()
            for a, b, _ in [*(s for s in base if s[0] < m.end() and m.start() < s[1]), (m.end(), m.end(), "")]:
                if a - at >= LEAST:
                    found.append((at, a, "cnn"))
                at = max(at, b)
    return found


def flagged_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a base span or a candidate: a keyword, or a long run of token bytes with a digit, or of a to f."""
    places = []
    lower = ascii_lower(data)
    raw = lower.tobytes()
    for word in KEYWORDS:
        at = raw.find(word)
        while at >= 0:
            places.append(at)
            at = raw.find(word, at + 1)
    cut = np.zeros(len(data) + 1, bool)  # runs end with their text
    cut[offsets] = True
    sums = np.r_[0, np.cumsum(DIGIT_BYTES[data])]
    lower_hex = ((data >= 97) & (data <= 102)) | DIGIT_BYTES[data]
    capitals = ((data >= 65) & (data <= 90)) | DIGIT_BYTES[data]
    for inside, digits in ((TOKEN_BYTES[data], True), (lower_hex, False), (capitals, False)):
        before, behind = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
        start = np.flatnonzero(inside & (~before | cut[:-1]))
        end = np.flatnonzero(inside & (~behind | cut[1:])) + 1
        keep = end - start >= 16
        if digits:
            keep &= sums[end] > sums[start]
        places += start[keep].tolist()
    if not len(data):
        return np.zeros(0, np.int64)
    return np.unique(np.searchsorted(offsets, np.array(places, np.int64), "right") - 1)


def windows(span: Span) -> Iterator[Span]:
    """The span if it is short, or else stretches that cover it: each a quarter further on, the last at its end."""
    start, end, kind = span
    if end - start <= INSIDE:
        yield span
        return
    for width in (INSIDE, INSIDE // 2):
        for at in range(start, end - width, width // 4):
            yield at, at + width, kind
        yield end - width, end, kind


def encode_windows(text: str, spans: list[Span]) -> np.ndarray:
    """[spans, LENGTH] codes: 1 to 96 for printable ASCII and others, plus 100 inside the candidate."""
    out = np.zeros((len(spans), LENGTH), np.int64)
    for r, (start, end, _) in enumerate(spans):
        lead = text[max(0, start - BEFORE) : start]
        body = text[start : min(end, start + INSIDE)]
        tail = text[end : end + AFTER]
        for at, part, shift in ((BEFORE - len(lead), lead, 0), (BEFORE, body, 100), (BEFORE + INSIDE, tail, 0)):
            out[r, at : at + len(part)] = [shift + (ord(c) - 31 if 32 <= ord(c) < 127 else 96) for c in part]
    return out


@dataclass
class CharCnn:
    """Embedding, one convolution with ReLU, maximum and mean over places, and a linear layer."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    WIDTH, FILTERS, DIM = 5, 24, 8

    @classmethod
    def start(cls, rng: np.random.Generator) -> CharCnn:
        return cls(rng.normal(0, 0.5, (200, cls.DIM)), rng.normal(0, 0.25, (cls.WIDTH * cls.DIM, cls.FILTERS)), np.zeros(cls.FILTERS), rng.normal(0, 0.2, 2 * cls.FILTERS), 0.0)

    def _forward(self, codes: np.ndarray) -> tuple:
        x = self.embed[codes] * (codes > 0)[:, :, None]
        view = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1)  # [n, places, DIM, WIDTH]
        patches = view.transpose(0, 1, 3, 2).reshape(len(codes), -1, self.WIDTH * self.DIM)
        active = np.maximum(patches @ self.kernel + self.shift, 0)
        top = active.argmax(axis=1)
        pooled = np.concatenate([active.max(axis=1), active.mean(axis=1)], axis=1)
        return patches, active, top, pooled, pooled @ self.dense + self.bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 256])[-1] for i in range(0, len(codes), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.offset, -35, 35)))

    def scores(self, text: str, spans: list[Span]) -> np.ndarray:
        """The largest probability of each span's windows."""
        best = np.zeros(len(spans))
        placed = ((i, w) for i, s in enumerate(spans) for w in windows(s))
        while part := list(islice(placed, WINDOWS)):
            np.maximum.at(best, [i for i, _ in part], self.probability(encode_windows(text, [w for _, w in part])))
        return best

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        patches, active, top, pooled, z = self._forward(codes)
        gap = (1 / (1 + np.exp(-z)) - labels) / len(labels)
        d_pool = gap[:, None] * self.dense
        d_act = np.broadcast_to(d_pool[:, None, self.FILTERS :] / active.shape[1], active.shape).copy()
        n, f = np.meshgrid(np.arange(len(codes)), np.arange(self.FILTERS), indexing="ij")
        d_act[n, top, f] += d_pool[:, : self.FILTERS]
        d_act *= active > 0
        flat = d_act.reshape(-1, self.FILTERS)
        d_patch = (d_act @ self.kernel.T).reshape(len(codes), -1, self.WIDTH, self.DIM)
        d_x = np.zeros((len(codes), codes.shape[1], self.DIM))
        for j in range(self.WIDTH):
            d_x[:, j : j + d_patch.shape[1]] += d_patch[:, :, j]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, codes, d_x * (codes > 0)[:, :, None])
        return [d_embed, patches.reshape(-1, patches.shape[-1]).T @ flat, flat.sum(axis=0), pooled.T @ gap, gap.sum()]


_PROSE = "the of and to in is that it was for on are as with they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


def labelled_findings(n: int = 3600, seed: int = 11) -> tuple[list[tuple[str, Span]], np.ndarray]:
    """Texts with one candidate each, and whether it is a secret."""
    rng = np.random.default_rng(seed)
    alnum, hexes, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    pick = lambda s, k: "".join(s[i] for i in rng.integers(len(s), size=k))
    word = lambda: _PROSE[rng.integers(len(_PROSE))]
    digits = string.digits

    def secret() -> str:
        kind = rng.integers(8)
        k = int(rng.integers(20, 48))
        return [pick(hexes, k), pick(hexes, k).upper(), pick(alnum, k), pick(b64, k) + "=" * int(rng.integers(3)), "ghp_" + pick(alnum, 36), "AKIA" + pick(string.ascii_uppercase + digits, 16), "eyJ" + pick(alnum, k), f"{pick(alnum, 8)}-{pick(alnum, 16)}_{pick(alnum, 12)}"][kind]

    def harmless() -> str:
        kind = rng.integers(9)
        number = pick(digits, int(rng.integers(1, 5)))
        words = [word() for _ in range(int(rng.integers(4, 9)))]
        return [
            "_".join(words) + number,
            "-".join(words) + "-" + number,
            "".join(w.capitalize() for w in words) + number,
            "/".join(words) + "/" + number,
            f"20{pick(digits, 2)}-{pick('01', 2)}-{pick('012', 2)}T{pick('01', 2)}-{pick(digits, 2)}-{word()}",
            word() * 4 + number + word() * 2,
            word()[:1] * 15 + number,
            f"{words[0]}_v{number}_{words[1]}_{words[2]}_final",
            f"{number}{''.join(words)}",
        ][kind].ljust(16, "s")

    texts, labels = [], []
    for i in range(n):
        own = bool(i % 2)
        body = secret() if own else harmless()
        lead = " ".join(word() for _ in range(int(rng.integers(0, 8))))
        joint = [" ", ' = "', ": ", " (", "\n", " key=", " id=", " file "][rng.integers(8)]
        tail = [" ", '"', ".", ")", "\n", "", ", "][rng.integers(7)] + " ".join(word() for _ in range(3))
        text = lead + joint + body + tail
        start = len(lead + joint)
        texts.append((text, (start, start + len(body), "cnn")))
        labels.append(own)
    return texts, np.array(labels, float)


@lru_cache(maxsize=4)
def trained(recall: float = 0.95, epochs: int = 8) -> CharCnn:
    """The network after training, calibration and the choice of its threshold."""
    rng = np.random.default_rng(3)
    texts, labels = labelled_findings()
    codes = np.concatenate([encode_windows(t, [s]) for t, s in texts])
    fold = len(labels) * 2 // 3
    net = CharCnn.start(rng)
    names = ("embed", "kernel", "shift", "dense", "bias")
    m, v, step = [np.zeros_like(np.asarray(getattr(net, k), float)) for k in names], [np.zeros_like(np.asarray(getattr(net, k), float)) for k in names], 0
    for _ in range(epochs):
        order = rng.permutation(fold)
        for a in range(0, fold, 64):
            step += 1
            for i, g in enumerate(net.gradients(codes[order[a : a + 64]], labels[order[a : a + 64]])):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                move = 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
                setattr(net, names[i], getattr(net, names[i]) - move)
    z, y = net.logits(codes[fold:]), labels[fold:]
    slope, offset = 1.0, 0.0
    for _ in range(500):  # Platt scaling, with the usual smoothed targets
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        gap = 1 / (1 + np.exp(-np.clip(slope * z + offset, -35, 35))) - target
        slope, offset = slope - 0.02 * (gap * z).mean(), offset - 0.05 * gap.mean()
    net.slope, net.offset = float(slope), float(offset)
    good = np.sort(net.probability(codes[fold:])[y == 1])
    n = len(good)
    rate = (n - np.arange(n)) / n  # recall with the threshold at each of them
    lower = (rate + 1.92 / n - 1.96 * np.sqrt(rate * (1 - rate) / n + 0.96 / n**2)) / (1 + 3.84 / n)  # Wilson
    passing = np.flatnonzero(lower >= recall)
    net.threshold = float(good[passing[-1]]) if len(passing) else float(good[0])
    return net


def all_spans(text: str, net: CharCnn) -> list[Span]:
    base = base_spans(text)
    others = other_candidates(text, base)
    if others:
        others = [s for s, p in zip(others, net.scores(text, others)) if p >= net.threshold]
    return sorted(base + others, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.95) -> DataFrame:
    """``id_col``, n_assign, n_access, n_hex, n_cnn, base_sha256, spans, least_score (of all spans): one row per document."""
    net = trained(recall)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in byte_slices(batches, "t"):
            n = batch.num_rows
            counts, sums, spans, least = np.zeros((4, n), np.int64), [nothing] * n, [""] * n, [None] * n
            for r in flagged_rows(*text_buffer(batch.column(1))).tolist():
                text = batch.column(1)[r].as_py() or ""
                found = all_spans(text, net)
                base = [s for s in found if s[2] != "cnn"]
                for i, name in enumerate(KINDS):
                    counts[i, r] = sum(s[2] == name for s in found)
                if found:
                    sums[r], spans[r] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)
                    least[r] = float(net.scores(text, found).min())
            columns = [batch.column(0), *(pa.array(c) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans", "least_score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_cnn bigint, base_sha256 string, spans string, least_score double")
    return found.withColumnRenamed("id", id_col)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """``text`` with every stretch covered by spans replaced by one mask."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if end > at:
            out += [text[at:start], mask] if start >= at and (start > at or not out) else []
            at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, recall: float = 0.95, length_col: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; all rows and columns stay, null texts stay null.
    ``length_col`` (a long) is brought up to date where a text changes."""
    net = trained(recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            new = {}
            for r in flagged_rows(*text_buffer(batch.column(at))).tolist():
                if text := batch.column(at)[r].as_py():
                    if spans := all_spans(text, net):
                        new[r] = redact(text, spans)
            if new:
                texts = batch.column(at).to_pylist()
                for r, text in new.items():
                    texts[r] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if length_col:
                    place = batch.schema.get_field_index(length_col)
                    sizes = batch.column(place).to_pylist()
                    for r, text in new.items():
                        sizes[r] = len(text)
                    batch = batch.set_column(place, batch.schema.field(place), pa.array(sizes, batch.schema.field(place).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
