import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_output as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_coding_round_trip(ranks):
    control, data = T.encode_ranks(np.array(ranks, dtype=np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, -(-x.bit_length() // 8)) for x in ranks)
    assert T.decode_ranks(control, data, len(ranks)).tolist() == ranks


CHUNKED = T.ChunkTokenizer(open(PATH, encoding="utf-8").read())
PIECES = st.sampled_from(["a", "word", "é", "don't", "x's", "!!", "...", "7", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "\x1c", "\x00", "<|endoftext|>", "日本", ",", "A"])


PLAIN = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join) | st.text(max_size=20), max_size=4))
def test_chunks_give_the_ids_of_the_whole_text(texts):
    want = [PLAIN.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert [T._ids(x.as_py(), 2).tolist() for x in CHUNKED.encode(pa.array(texts, pa.string()), 0)] == want


def test_strings_of_added_tokens_are_the_librarys():
    got = T._ids(CHUNKED.encode(pa.array(["a <|endoftext|> b"]), 0)[0].as_py(), 2).tolist()
    assert got == [64, 220, 50256, 275, 0]


def test_a_full_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(T, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(T, "CACHE_MATCHES", 2)
    own = T.ChunkTokenizer(open(PATH, encoding="utf-8").read())
    for text in ["a few more words than fit", "others, then", "a few more words", ""]:
        assert T._ids(own.encode(pa.array([text]), 0)[0].as_py(), 2).tolist() == PLAIN.encode(text, add_special_tokens=False).ids + [0]


def test_other_kinds_of_vocabulary_are_left_to_the_library():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        own = T.ChunkTokenizer(json.dumps(spec | change))
        library = Tokenizer.from_str(json.dumps(spec | change))
        text = "Some Words,\nand <|endoftext|> More"
        assert not own.chunked and T._ids(own.encode(pa.array([text]), 0)[0].as_py(), 2).tolist() == library.encode(text, add_special_tokens=False).ids + [0]


def brute(rows, plain):
    out = []
    for r in rows:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        out.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    return out


def check(frame, plain):
    got = T.token_output(frame, PATH).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(brute(frame.collect(), plain), key=str)
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1


def test_against_the_library(docs, plain):
    check(docs, plain)


def test_odd(odd, plain):
    check(odd, plain)


def test_empty(none):
    assert T.token_output(none, PATH).collect() == []


def test_ids_are_read_back(spark, odd, plain, tmp_path):
    T.write_tokens(odd, str(tmp_path / "t"), PATH)
    got = {(r.doc_id, r.n_tokens): r.ids for r in T.read_tokens(spark, str(tmp_path / "t")).collect()}
    for r in odd.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert got[(r.doc_id, len(ids))] == ids
    ranks = spark.read.parquet(str(tmp_path / "t" / "ranks")).orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)
