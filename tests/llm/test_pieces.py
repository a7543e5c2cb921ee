"""SentencePiece ids by a table of distinct chunks against the library on whole texts."""

import hashlib

import pytest
import sentencepiece

from litscore.llm import pieces
from litscore.llm.pieces import Segmenter, encode_pieces, piece_digest
from litscore.llm.tokens import tokenizer_path

ODD = [
    "", " ", "   ", "a", " a", "a ", "  a  b  ", "x\ty\nz", "\n\n", "tab\t \tend", "é😀 z", "　q", "x y",
    "ab\x0bcd\x1c e", "the the the the", "<s> </s> <unk>", "12345 67.89", "日本語のテキスト です", "a" * 5000,
    " ".join(["word"] * 3000), "mixed  spaces\t\tand\r\nlines ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_chunks_give_the_library_ids(library):
    model = Segmenter(tokenizer_path("piece_bpe_32k.model"))
    flat, offsets = model(ODD)
    for i, text in enumerate(ODD):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == library.encode(text), repr(text)


def test_table_and_cache_agree(library):
    model = Segmenter(tokenizer_path("piece_bpe_32k.model"))
    chunks = sorted({c for t in ODD for c in model.chunks(t)})[::2]
    model.load(chunks, model.segment(chunks))
    for _ in range(2):  # the second time from the cache
        flat, offsets = model(ODD)
        for i, text in enumerate(ODD):
            assert flat[offsets[i] : offsets[i + 1]].tolist() == library.encode(text)


def test_rows_equal_the_library(documents, library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)  # most chunks outside the table
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "the the"), (101, "the the"), (None, "kept")]
    got = piece_digest(encode_pieces(documents(rows), tokenizer_path("piece_bpe_32k.model"))).collect()
    assert len(got) == len(rows)
    got = sorted(((r.doc_id is None, r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append(((i is None, i), len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_whole_table_fits_the_bound(documents, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 2)
    chunks, ids = pieces.chunk_table(documents([(1, "a b a b c"), (2, "a b a")]).select("text"), tokenizer_path("piece_bpe_32k.model"))
    assert sorted(chunks) == [" a", " b"] and len(ids) == 2


def test_empty_table(documents):
    empty = documents([(1, "x")]).where("doc_id < 0")
    assert encode_pieces(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0
