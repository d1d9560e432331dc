import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_output as O
from tidemark.llm.common import work_path
from tidemark.llm.tokens import ChunkEncoder

from .helpers import edge, edge_rows, empty

BYTE, WORD = str(P.path("byte_bpe_50k.json")), str(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_chunks_give_the_ids_of_the_whole_text(path, kind):
    enc, tok = ChunkEncoder(path, kind), Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["a  b", " a", "a ", "  ", "\n \n x", "x\n y \n\n z", "a\x1cb c", "é x <|endoftext|> |", "| |a | b", "", "it's  'll ok", "x  y", "Ġ Ġx", *(t or "" for _, t, *_ in edge_rows())]
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_emptied_table_still_encodes(monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.ENTRIES", 3)
    enc, tok = ChunkEncoder(BYTE, "byte"), Tokenizer.from_file(BYTE)
    for text in ("alpha beta gamma delta epsilon", "beta zeta eta theta alpha", "iota kappa lambda mu alpha beta"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text).ids


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_batches_of_random_texts(path, kind, monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.BATCH_CHARS", 400)
    enc, tok = ChunkEncoder(path, kind), Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rng = np.random.default_rng(3)
    parts = ["alpha", "Beta's", "12,5", "é", "x|y", "|", "\n", "\t", "  ", "naïve", "日本", "a\nb", "."]
    for _ in range(20):
        texts = [" ".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(15)] + [None, ""]
        for text, ids in zip(texts, enc.encode_many(texts)):
            assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


def brute(rows):
    tok = Tokenizer.from_file(BYTE)
    out, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_digest_matches_brute_force(spark):
    found = [tuple(r) for r in O.token_digest(edge(spark), BYTE).collect()]
    assert sorted(found, key=lambda r: r[1]) == brute(edge_rows())


def test_round_trip_and_single_documents(spark):
    path = work_path(spark, "test-tokens")
    docs = spark.createDataFrame([(i, f"document {i} says " + "word " * (i % 50)) for i in range(400)], "doc_id long, text string")
    O.write_tokens(docs, path, BYTE, shard_bytes=2000)
    tok = Tokenizer.from_file(BYTE)
    rows = O.read_tokens(spark, path, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: tok.encode(f"document {i} says " + "word " * (i % 50)).ids + [2] for i in range(400)}
    assert len({(r.part, r.number) for r in rows}) > 4
    assert O.read_document(spark, path, 7) == [tok.encode("document 7 says " + "word " * 7).ids + [2]]
    assert O.read_document(spark, path, 9999) == []


def test_empty_table(spark):
    assert O.token_digest(empty(spark), BYTE).collect() == []


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_chunks_that_share_a_hash(path, kind, monkeypatch):
    word = "a"
    while len(word) < 2048:  # this word and its complement share every polynomial hash modulo 2 ** 64
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    enc, tok = ChunkEncoder(path, kind), Tokenizer.from_file(path)
    texts = [f"x {word}", f"x {other}", f"x {word} {other} y"]
    for text, ids in zip(texts, enc.encode_many(texts)):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr("tidemark.llm.tokens.chunk_hashes", lambda raw, begin, end: (end - begin).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    enc = ChunkEncoder(path, kind)
    texts = ["x one two six ten " * 3 + "seventeen letters unbelievablenesses misunderstandings", "x ten misunderstandings unbelievablenesses"] * 2
    for text, ids in zip(texts, enc.encode_many(texts)):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_narrow_ids_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        O.write_tokens(docs, work_path(spark, "test-narrow"), BYTE, end_id=70_000)


def test_single_documents_by_ranges(spark, monkeypatch):
    path = work_path(spark, "test-ranges")
    rows = [(None, "none"), (None, None), (-5, "minus"), *((i, f"text {i} " * (i % 7)) for i in range(0, 600, 3)), (300, "again"), (300, "and again")]
    monkeypatch.setitem(O.__dict__, "DICT_BYTES", 1024)
    O.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, BYTE, shard_bytes=600)
    tok = Tokenizer.from_file(BYTE)
    want = lambda k: sorted(tok.encode(t or "").ids + [2] for i, t in rows if i == k)
    taken = []
    read = O.Ranges.read
    monkeypatch.setattr(O.Ranges, "read", lambda self, file, start, length: (taken.append((file, length)), read(self, file, start, length))[1])
    for k in (-5, 0, 3, 300, 597, 1, 10_000, -6):
        taken.clear()
        assert sorted(O.read_document(spark, path, k)) == want(k), k
        assert len({f for f, n in taken if n > O.HEAD.size}) <= 2


def test_session_compression_leaves_files_alone(spark):
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.output.fileoutputformat.compress", "true")
    try:
        assert sorted(tuple(r) for r in O.token_digest(edge(spark), BYTE).collect() if r[0]) == sorted(r for r in brute(edge_rows()) if r[0])
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.output.fileoutputformat.compress")
