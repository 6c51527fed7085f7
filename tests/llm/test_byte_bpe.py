"""Byte-level BPE against the tiktoken library and as a round trip."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewright.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGES = ["", None, "it's  a\t\n test \n", " " * 300 + "x", "z" * 5000, "中文 ½ naïve İ \x1c\x85\xa0b", "<|endoftext|>", "same", "same", "ab" * 40, " lead  in", "tail ", "one  two   three", "tab\t end", "new\n line\n\n  x", "a " * 50 + "b"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(PATH), special_tokens={})


def expected(library, doc, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_edges(spark, library):
    rows = [(None if i == 2 else i, t, "x", "y") for i, t in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk string")
    got = byte_bpe.encode(df, PATH, public_tokenizers.PATTERN, keep=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((expected(library, r[0], r[1]) for r in rows), key=str)
    assert all(library.decode_bytes(r.ids) == bytes(r.decoded) for r in got)
    assert byte_bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.QUERIES["op8_byte_bpe"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(expected(library, r.doc_id, r.text) for r in docs)


def test_fold_and_long_merge_agree(spark, library):
    words = ["x", " thinonat", "ééé", "\x00\xff", "aaaaaaaaaaaaaaaaaaaaaaaa", " Straße", "\n\n\n"]
    ranks = byte_bpe.rank_table(PATH)
    df = spark.createDataFrame([(w.encode(),) for w in words], "word binary")
    got = {bytes(r.word).decode(): list(r.ids) for r in df.select("word", byte_bpe.fold(byte_bpe.bytes_of(F.col("word")), ranks).alias("ids")).collect()}
    for w in words:
        assert got[w] == byte_bpe.merge_long(w.encode(), ranks) == library.encode_ordinary(w)


def test_fold_evaluates_a_merge_once(spark):
    """The lowest pair and its place are looked for once a step: an expression of a lambda that is written twice is evaluated twice."""
    df = spark.createDataFrame([(b" thinonat",)], "word binary").select(byte_bpe.fold(byte_bpe.bytes_of(F.col("word")), byte_bpe.rank_table(PATH)).alias("ids"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_position(") == 1 and plan.count("array_min(") == 1


def test_decode(spark):
    ids = spark.createDataFrame([([0, 50, 200],), ([],), (None,)], "ids array<int>")
    pieces = {rank: token for token, rank in byte_bpe.rank_table(PATH).items()}
    got = [r.decoded and bytes(r.decoded) for r in byte_bpe.decode(ids, PATH).collect()]
    assert got == [pieces[0] + pieces[50] + pieces[200], b"", None] or got == [pieces[0] + pieces[50] + pieces[200], bytearray(b""), None]


def test_known_words_are_not_split_again(monkeypatch, tmp_path):
    """A piece that is a known word takes its ids from the table; other decoded bytes reach the text."""
    ranks = byte_bpe.rank_table(PATH)
    words = byte_bpe.WordIds(str(tmp_path), "none", ranks, {rank: token for token, rank in ranks.items()})
    words.update({" cat": ("1 2", None), " dog": ("3", b" cow")})
    between = byte_bpe.PieceIds(words)
    assert between.joined(["", "cat", "cat"], " cat cat") == ("1 2 1 2", None)
    assert between.joined(["", "cat", "dog"], " cat dog") == ("1 2 3", b" cat cow")
    assert between.joined(["", "cat"], " cat") == ("1 2", None)
    monkeypatch.setattr(byte_bpe, "BYTE_LEVEL", None)
    assert byte_bpe.PieceIds(words)["dog"] == "3"
