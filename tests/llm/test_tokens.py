import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuewright.llm.sentencepiece_codec import BPE, PieceCodec, PieceModel, encode_decode
from cuewright.llm.token_files import EliasFano, WordBpe, pack_block, range_edges, read_blocks, token_files

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b   ", "\n\na\tb\x1cc", "don't DON'T x<|endoftext|>y", "É é É ̧ H̱", "漢字 🙂 naïve", "ÀÉ!! x### y$$$ (foo). İ", "a " + " " * 9 + "b", "▁x ▁"]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=600))
@settings(max_examples=60, deadline=None)
def test_elias_fano_selects_every_value(values):
    values = np.sort(np.array(values))
    coded = EliasFano.encode(values)
    assert coded.select_many(0, len(values)).tolist() == values.tolist()
    third = len(values) // 3
    assert coded.select_many(third, len(values) - third).tolist() == values[third : len(values) - third].tolist()
    assert [coded.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    again, _ = EliasFano.read(np.frombuffer(coded.tobytes(), np.uint8), 0, len(values), coded.sizes())
    assert again.select_many(0, len(values)).tolist() == values.tolist()


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.encode(ends).tobytes()) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 0.5


def test_block_round_trip():
    counts, ids = np.array([2, 0, 3]), np.array([5, 70_000, 1, 2, 3], np.uint32)
    data = pack_block(3, 1, [None, -7, 9], counts, ids) + b"\n"
    (part, block, docs, bounds, back), again = list(read_blocks(data * 2))
    assert (part, block, docs, bounds.select_many(0, bounds.n).tolist(), back.tolist()) == (3, 1, [None, -7, 9], [0, 2, 2, 5], ids.tolist())


def test_word_encoder_equals_the_library():
    own, library = WordBpe(WORD), Tokenizer.from_file(WORD)
    ids, ends = own(pa.array(ODD))
    for i, text in enumerate(ODD):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_digest(docs, rows):
    library = Tokenizer.from_file(WORD)
    expected, start = [], 0
    for doc_id, text in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(map(tuple, rows), key=lambda r: r[1]), expected


def test_files_hold_all_documents_in_order(spark, small, monkeypatch):
    from cuewright.llm import token_files as module

    monkeypatch.setattr(module, "PART_BYTES", 60_000)
    monkeypatch.setattr(module, "PARTS_A_GROUP", 3)
    monkeypatch.setattr(module, "BLOCK_IDS", 400)
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    found, expected = check_digest(docs, token_files(docs, WordBpe(WORD), 2).collect())
    assert found == expected


def test_boundaries_come_from_select(monkeypatch):
    monkeypatch.setattr(EliasFano, "select_many", None)
    data = pack_block(0, 0, [1], np.array([1]), np.array([7], np.uint32)) + b"\n"
    try:
        list(read_blocks(data))
    except TypeError:
        return
    raise AssertionError("read without select")


def test_ranges_of_skewed_ids(spark):
    ids = [(i,) for i in [*range(1000), *range(1 << 50, (1 << 50) + 3000), -(1 << 62), (1 << 62), *[5] * 500, None]]
    df = spark.createDataFrame(ids, "id long")
    edges = range_edges(df, 10)
    assert (np.diff(edges) > 0).all() and 7 <= len(edges) <= 9
    sizes = np.bincount(np.searchsorted(edges, [i for i, in ids if i is not None], "right"), minlength=len(edges) + 1)
    assert sizes.max() <= 2.5 * 4502 / 10
    assert len(range_edges(df, 1)) == len(range_edges(df.limit(0), 9)) == 0


def test_files_of_odd_rows(spark, odd_docs):
    rows = token_files(odd_docs, WordBpe(WORD), 2).collect()
    found, expected = check_digest(odd_docs, rows)
    assert sorted(x[0] is None for x in found) == sorted(x[0] is None for x in expected)
    assert sorted((x[2], x[3]) for x in found) == sorted((x[2], x[3]) for x in expected)
    assert [x[0] for x in found] == [x[0] for x in expected]
    assert [x[1] for x in found] == [0, *np.cumsum([x[2] for x in found])[:-1].tolist()]
    assert token_files(odd_docs.limit(0), WordBpe(WORD), 2).collect() == []


def test_parity_is_verified_when_a_model_is_opened(monkeypatch):
    from cuewright.llm import sentencepiece_codec as module

    asked = []
    monkeypatch.setattr(module, "_SHARED", {})
    monkeypatch.setattr(PieceCodec, "differences", lambda self, texts: asked.append(texts) or [0])
    with pytest.raises(ValueError, match="ids differ"):
        PieceCodec(PIECE)._open()
    assert asked == [module.PARITY_SAMPLE]


def test_texts_are_encoded_in_batches_on_threads(monkeypatch):
    import os

    from cuewright.llm import sentencepiece_codec as module

    class Spy:
        def encode_batch_fast(self, texts, add_special_tokens):
            self.seen = texts
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    codec, spy = PieceCodec(PIECE), Spy()
    model, library, surfaces = codec._open()
    assert os.environ["TOKENIZERS_PARALLELISM"] == "true"
    monkeypatch.setattr(module, "_SHARED", {PIECE: (model, spy, surfaces)})
    ids, ends = codec.encode(pa.array(["two words", None, "x"]))
    assert spy.seen == ["two words", "", "x"] and len(ends) == 4 and ends[-1] == len(ids)


def test_pieces_equal_sentencepiece(spark, small):
    codec = PieceCodec(PIECE)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ODD
    assert codec.differences(texts) == []
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids, ends = codec.encode(pa.array(texts))
    assert [x.decode() for x in codec.decode(ids, ends)] == [library.decode(library.encode(t)) for t in texts]


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        raw = value.encode() if isinstance(value, str) else value
        key, size = number << 3 | (2 if isinstance(raw, bytes) else 0), len(raw) if isinstance(raw, bytes) else raw
        for n in (key, size):
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            out += bytes([n])
        out += raw if isinstance(raw, bytes) else b""
    return out


def test_unigram_models_are_rebuilt(tmp_path):
    """A hand-made unigram model with byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1), ("ba", -4.1, 1), ("c", -5.0, 1), ("abc", -4.6, 1)]
    data = b"".join(message((1, message((1, p), (2, s), (3, t)))) for p, s, t in pieces)
    data += message((2, message((3, 1), (35, 1)))) + message((3, message((1, "identity"), (3, 1), (4, 1), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    assert PieceModel.parse(data).model_type == 1
    assert PieceCodec(str(path)).differences(["ab abc", "aabbab  ba", " cab ", "", "baab abcab ababc"]) == []
    assert PieceModel.parse(open(PIECE, "rb").read()).model_type == BPE


def test_odd_rows_encode_and_decode(spark, odd_docs):
    rows = encode_decode(odd_docs, PIECE, decoded=True).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    assert sorted(r.decoded for r in rows) == sorted(r.text or "" for r in odd_docs.collect())
    assert all(r.n_tokens == 0 for r in rows if r.decoded == "")
    assert encode_decode(odd_docs.limit(0), PIECE).collect() == []
