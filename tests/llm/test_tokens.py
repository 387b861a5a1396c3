import json
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evidentia.llm import tokens as T
from evidentia.llm.common import tokenizer_path

PIECES = ["a", "the", "B", " ", "  ", "\n", "\t", "\r\n", "é", "1", "'s", ".", "<|endoftext|>", "　", "\x85", "\x1c", "\xa0", "ß", "²", "日本", "🙂", "​", " \n", "x", ".\n", ", ", "&&&"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("seed", range(4))
def test_pieces_are_encoded_as_in_their_text(tokenizer, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    if seed % 2:
        texts = [t for t in texts if not re.search(r" (?!\S)", t)]
    ids, counts = T.Encoder(tokenizer_path()).encode(pa.array(texts), 2)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)
        at += n


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 70_000])
@pytest.mark.parametrize("top", [3, 50_257, 2**32])
def test_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    if n > 10:
        ids[rng.integers(0, n, 5)] = 2**32 - 1  # exceptions
    s = T.Segment(T.encode_segment([4, None], [n // 3, n - n // 3], ids))
    assert s.doc_ids == [4, None] and s.n_tokens.tolist() == [n // 3, n - n // 3]
    assert (s.ids() == ids).all() and (s.ids(n // 4, n // 2) == ids[n // 4 : n // 2]).all()


def test_exceptions_keep_blocks_narrow():
    ids = np.full(T.BLOCK, 7, np.uint32)
    ids[::50] = 2**31
    assert len(T.encode_segment([1], [len(ids)], ids)) < 500


def test_query_against_brute_force(spark, tokenizer, monkeypatch):
    rows = [(7, "hello world", "x", 1), (3, None, "x", 1), (5, "", "x", 1), (9, "long word " * 30_000, "x", 1), (1, "  spaces\n\nand <|endoftext|> ", "x", 1), (None, "no id", "x", 1), (7, "hello world", "x", 1), (7, "a text", None, None)]
    got = T.token_digest(spark.createDataFrame(rows, "doc_id long, text string, shard string, seq int"), tokenizer_path())
    want, at = [], 0
    for d, t in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert T.token_digest(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def changed(tmp_path, **parts):
    t = json.loads(Path(tokenizer_path()).read_text()) | parts
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(t))
    return str(path)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    texts = ["Hello  World, hello", "", " a b\nc ", "\u00e9\u00e8 x y", "xx <|endoftext|> yy"]
    assert T.cuts_at_spaces(tokenizer_path()) and not T.cuts_at_spaces(tokenizer_path("word_bpe_49k.json"))
    added = [{"id": 50256, "content": "<|end of text|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    prefix = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    paths = [tokenizer_path("word_bpe_49k.json"), changed(tmp_path, normalizer={"type": "Lowercase"}), changed(tmp_path, added_tokens=added), changed(tmp_path, pre_tokenizer=prefix), changed(tmp_path, pre_tokenizer=None)]
    for path in paths:
        t = Tokenizer.from_file(path)
        encoder = T.Encoder(path)
        assert encoder.whole
        ids, counts = encoder.encode(pa.array(texts), 2)
        want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_whole_texts_through_the_query(spark):
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(2, "Some words"), (1, None), (3, "more WORDS " * 500)]
    got = sorted(map(tuple, T.token_digest(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()))
    at = 0
    for (d, text), g in zip(sorted(rows, key=lambda r: r[0]), got):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert g == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_whole_table_is_encoded_as_whole_texts(tokenizer):
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    texts = [r[0] or "" for r in rows]
    ids, counts = T.Encoder(tokenizer_path()).encode(pa.array(texts), 2)
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
