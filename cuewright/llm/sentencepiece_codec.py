"""SentencePiece models on the tokenizers library: encode, decode, and a parity check.

The model file is read with a small protobuf reader. From it are rebuilt the normaliser (character
map, white-space rules, dummy prefix), the metaspace marker, the unigram scores or the BPE merges
(two pieces merge if their concatenation is a piece; better scores first) and byte fallback.
Whole texts are encoded in batches on the library's threads. Parity with the sentencepiece library, ids and decoded text, is verified when a
worker opens the model (``PARITY_SAMPLE``) and on the head of the first text of every slice; a
difference is an error.

Defined results: null text is empty and has no ids. Characters outside the vocabulary become byte
pieces, or the unknown id in a model without them. Special tokens are never added. Other columns of
the input are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import byte_slices

MARK = "▁"
#: Texts with which parity is verified when a model is opened, and characters of a text looked at for each slice.
PARITY_SAMPLE = [
    "", " ", "a", "  two  spaces ", "tab\tand\nline", "don't stop, ever!", "naïve café É", "漢字とかな", "🙂🙃 emoji", "Ünïcödé ﬁ ①", "123 4,567.89", "▁marker ▁", "a\u0301 b\u200bc", "x" * 40,
]
PARITY_CHARS = 2000
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the trainer spec (fixed values).
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and raw value of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = {1: 8, 5: 4}[kind]
            at += n
            yield key >> 3, data[at - n : at]


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unknown_id: int = 0
    unknown_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        self = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.model_type, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                self.unknown_id = own.get(40, 0)
                self.unknown_surface = own[44].decode() if 44 in own else self.unknown_surface
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze_spaces, self.escape_spaces = (bool(own.get(i, 1)) for i in (3, 4, 5))
        return self

    def merges(self) -> list[tuple[str, str]]:
        rank = {p: i for i, p in enumerate(self.pieces)}
        found = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.types)):
            if kind in (NORMAL, USER):
                for cut in range(1, len(piece)):
                    a, b = piece[:cut], piece[cut:]
                    if a in rank and b in rank:
                        found.append((-self.scores[i], i, rank[a], rank[b], a, b))
        return [x[-2:] for x in sorted(found)]

    def tokenizer(self):
        """The whole model as a ``tokenizers.Tokenizer``."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        if self.model_type == BPE:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown_id], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.model_type == UNIGRAM:
            core = models.Unigram(list(zip(self.pieces, self.scores)), self.unknown_id, self.byte_fallback)
        else:
            raise ValueError(f"model type {self.model_type}")
        made = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape_spaces else " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        if self.squeeze_spaces:
            steps.append(normalizers.Replace(Regex(f"{MARK if self.escape_spaces else ' '}+$"), ""))
        made.normalizer = normalizers.Sequence(steps)
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        made.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        made.add_tokens([AddedToken(p, normalized=False) for p, t in zip(self.pieces, self.types) if t == USER])
        return made

    def surfaces(self) -> list[bytes]:
        """The bytes that each id stands for when texts are decoded."""
        out = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.types)):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif i == self.unknown_id:
                out.append(self.unknown_surface.encode())
            else:
                out.append(piece.replace(MARK, " ").encode())
        return out


_SHARED: dict[str, tuple] = {}  # per worker and model file
_LIBRARY: dict[str, object] = {}


class PieceCodec:
    """Encodes columns of texts and decodes columns of ids with the model at ``path``."""

    def __init__(self, path: str):
        self.path = path

    def _open(self) -> tuple:
        if self.path not in _SHARED:
            os.environ["TOKENIZERS_PARALLELISM"] = "true"  # workers do not fork, so threads are safe
            with open(self.path, "rb") as file:
                model = PieceModel.parse(file.read())
            tokenizer = model.tokenizer()
            _SHARED[self.path] = model, tokenizer, pa.array(model.surfaces(), pa.large_binary())
            self.verify(PARITY_SAMPLE)
        return _SHARED[self.path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets (n + 1) of each text's ids."""
        _, tokenizer, _ = self._open()
        found = [e.ids for e in tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=ends[1:])
        return np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1])), ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text."""
        model, _, surfaces = self._open()
        taken = surfaces.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
        data = memoryview(taken.buffers()[2] or b"")
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            text = bytes(data[at[a] : at[b]])
            if model.squeeze_spaces:
                text = text.lstrip(b" ")
            out.append(text[1:] if model.dummy_prefix and text[:1] == b" " else text)
        return out

    def differences(self, texts: list[str]) -> list[int]:
        """Places of the texts whose ids, or what the ids decode to, differ from the sentencepiece library's."""
        if self.path not in _LIBRARY:
            import sentencepiece

            _LIBRARY[self.path] = sentencepiece.SentencePieceProcessor(model_file=self.path)
        library = _LIBRARY[self.path]
        theirs = library.encode(texts)
        ids, ends = self.encode(pa.array(texts, pa.string()))
        back = self.decode(ids, ends)
        return [i for i, own in enumerate(theirs) if ids[ends[i] : ends[i + 1]].tolist() != own or back[i].decode() != library.decode(own)]

    def verify(self, texts: list[str]) -> None:
        """The parity check: an error where a text's ids are not the sentencepiece library's."""
        if wrong := self.differences(texts):
            raise ValueError(f"ids differ from the sentencepiece library's: {texts[wrong[0]][:200]!r}")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), round_trip: whether the
    decoded ids are the text again; with ``decoded`` also that text."""
    codec = PieceCodec(model_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "t"):
            texts = batch.column(1).fill_null("")
            codec.verify([texts[0].as_py()[:PARITY_CHARS]])
            ids, ends = codec.encode(texts)
            view, at = memoryview(ids.astype("<u4").tobytes()), ends.tolist()
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            back = pa.array(codec.decode(ids, ends), pa.binary())
            same = pc.equal(back, texts.cast(pa.binary()))
            columns = [batch.column(0), pa.array(np.diff(ends)), pa.array(sums, pa.int64()), same]
            names = ["id", "n_tokens", "ids_crc32", "round_trip"]
            if decoded:
                columns, names = [*columns, back.cast(pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_tokens bigint, ids_crc32 bigint, round_trip boolean" + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
