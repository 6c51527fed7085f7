"""Packing, token records: against the library, document by document."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.llm import packing, queries, token_records
from tidewright.llm.tokens import Encoder, encoder

TEXTS = ["", None, "Hello  world's 42 tests.\n\n A", "a" * 3000, "x y " * 2500, "Ça ÉTÉ déjà Öl  nbsp 中文 ½ İ", "<|endoftext|> it's", "same", "same"]
SCHEMA = "doc_id long, text string, start string, id string"


def rows():
    return [(None if i == 3 else i // 2 if i > 6 else i, t, "x", None) for i, t in enumerate(TEXTS)]


@functools.cache
def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def library(name, text):
    return tokenizer(name).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(spark, sf, name):
    texts = [t or "" for t in TEXTS] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    enc = encoder(public_tokenizers.path(name))
    for text, packed in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(packed, enc.dtype).tolist() == library(name, text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_and_borders(name):
    rng = random.Random(4)
    parts = [" ", " ", "  ", "   ", "\n", "\t", "\r\n", "\x0b", "word", "Word's", "don't", "'s", "9", "42", "é", "Ö1", "_", "--", "?!", "a.b", "x,", "\u00a0", "中"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(4000)]
    enc = Encoder(public_tokenizers.path(name), limit=50)
    for text, packed in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(packed, enc.dtype).tolist() == library(name, text), repr(text)


def check_packing(pieces, wanted):
    """Each id of each document in exactly one piece, sequences gapless and not too long. wanted: (id, ids) of the documents."""
    sequences, documents = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        documents.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    for (doc, n), own in documents.items():
        ids = next(w for d, w in wanted if d == doc and len(w) == n)
        spans = sorted({(p.start, p.length, p.ids_crc32) for p in own})
        for start, length, crc in spans:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(len(w) for _, w in wanted)
    return len(sequences) * 1024 - sum(p.length for p in pieces)


def test_packing_edges(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    wanted = [(r[0], library("byte_bpe_50k.json", r[1] or "") + [0]) for r in rows()]
    assert check_packing(packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect(), wanted) < 2048
    assert packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    kept = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in kept)


def test_packing_query(spark, sf):
    wanted = [(r.doc_id, library("byte_bpe_50k.json", r.text) + [0]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = queries.QUERIES["op5_packing"](spark, sf).collect()
    assert check_packing(pieces, wanted) < 1024 * 4
    assert {p.doc_id for p in pieces} == {d for d, _ in wanted}


def test_deal_balances_cost():
    lengths = [700, 600, 500, 400, 300, 200, 100, 100, 90, 82]
    parts = packing.deal(lengths, 1024)
    used = {}
    for own, n in zip(parts, lengths, strict=True):
        assert sum(p[1] for p in own) == n
        for _, m, s, _ in own:
            used[s] = used.get(s, 0) + m
    assert all(u <= 1024 for u in used.values()) and len(used) == 3
    assert packing.deal([], 1024) == []


def test_record_frames():
    frame = token_records.framed(b"payload")
    assert token_records.unframed(frame) == b"payload"
    for at in (0, 9, 14, len(frame) - 1):
        damaged = bytearray(frame)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframed(bytes(damaged))


def test_records_round_trip(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame(rows(), SCHEMA)
    root = token_records.write_records(df, path)
    got = token_records.digests(token_records.read_records(spark, root), token_records.record_starts(spark, root)).orderBy("start").collect()
    at = 0
    wanted = sorted(((r[0], library("word_bpe_49k.json", r[1] or "") + [1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in wanted]
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(d), crc(w)) for d, w in wanted)
    empty = token_records.write_records(df.limit(0), path)
    assert token_records.read_records(spark, empty).count() == 0


def test_records_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op6_token_records"](spark, sf).orderBy("doc_id").collect()
    at = 0
    for d, r in zip(docs, got, strict=True):
        ids = library("word_bpe_49k.json", d.text) + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_records_are_read_in_pieces_of_bounded_size(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "some words " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    root = token_records.write_records(docs, queries.tokenizer_file("word_bpe_49k.json"), root=str(tmp_path / "records"))
    monkeypatch.setattr(token_records, "BYTES_AT_ONCE", 1_000)
    sizes = []

    class Watched:
        @staticmethod
        def mapInArrow(read, schema):
            import pyarrow.parquet as pq

            sizes.extend(b.num_rows for b in read(iter(pq.read_table(f"{root}/index").to_batches())))

    class Reader:
        class read:
            @staticmethod
            def parquet(path):
                return Watched

    token_records.read_records(Reader, root)
    assert sum(sizes) == 40 and max(sizes) <= 5
