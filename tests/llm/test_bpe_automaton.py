import hashlib
import itertools
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from evidentia.llm import bpe_automaton as B
from evidentia.llm.queries import op11_bpe_automaton

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def mine():
    return B.Tokenizer(B.read_spec(FILE))


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def merged(word, merges):
    """BPE as defined: each merge in order, leftmost pairs first."""
    row = list(word)
    for a, b, c in merges:
        i = 0
        while i + 1 < len(row):
            if row[i] == a and row[i + 1] == b:
                row[i : i + 2] = [c]
            i += 1
    return row


@pytest.mark.parametrize("seed", range(30))
def test_automaton_accepts_exactly_what_the_merges_give(seed):
    """Random merges over three bytes, also ones that never apply: every word of up to 7 bytes."""
    rng = random.Random(seed)
    labels, merges = [b"a", b"b", b"c"], []
    for _ in range(12):
        a, b = rng.randrange(len(labels)), rng.randrange(len(labels))
        if labels[a] + labels[b] not in labels:
            merges.append((a, b, len(labels)))
            labels.append(labels[a] + labels[b])
    auto = B.Automaton(labels, merges, [0, 1, 2])
    for n in range(1, 8):
        for word in itertools.product(range(3), repeat=n):
            want = merged(word, merges)
            text = b"".join(labels[i] for i in word)
            assert auto.encode(text) == want
            assert all(auto.follows(x, y) for x, y in zip(want, want[1:]))


def test_one_accepted_path_only():
    labels, merges = [b"a", b"b", b"ab", b"aa", b"aab"], [(0, 1, 2), (0, 0, 3), (0, 2, 4)]
    auto = B.Automaton(labels, merges, [0, 1])

    def paths(text, state):
        if not text:
            return [[]]
        return [[u, *rest] for u, label in enumerate(labels) if u in auto.tokens.values() and text.startswith(label) and (state is None or auto.follows(state, u)) for rest in paths(text[len(label) :], u)]

    for n in range(1, 9):
        for word in itertools.product(b"ab", repeat=n):
            assert [auto.encode(bytes(word))] == paths(bytes(word), None)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "Hello world", "  two  spaces ", "it's I'll x'S", "tab\t\nline\r\n\n", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b<|endof", "é ﬁ 日本語 \U0001F600", "\x00\x1c\x85\xa0　x", "՘x \U00018d09y z", "12345 6.7 -- ==" * 3, "a" * 100_000, " " * 50_001, "ab" * 40_000, "日" * 20_000, "xyzzy" * 30_000],
)
def test_texts_against_the_library(mine, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_random_texts_against_the_library(mine, library):
    rng = random.Random(3)
    parts = ["a", "th", "ing", " ", "  ", "\n", "'s", "<|endoftext|>", "é", "日", "7", "==", "\x00", "\U00018d09", "Q", "the", "."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    assert [mine.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_plain_special_strings():
    library = Library.from_file(FILE)
    library.encode_special_tokens = True
    assert B.Tokenizer(B.read_spec(FILE), plain=True).encode("a<|endoftext|>b") == library.encode("a<|endoftext|>b").ids


def test_ids_that_are_no_text(mine):
    """Bytes that are no UTF-8 become U+FFFD, unknown ids are left out."""
    half = mine.encode("日")[:1]
    assert mine.decode([*half, 999_999]) == "�"


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(FILE, encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            B.read_spec(str(tmp_path / "t.json"))


def test_rows(spark, library):
    texts = [None, "", "one two", "one two", "x" * 3_000_000, "<|endoftext|>"]
    rows = [(i if i else None, t, 7, "k") for i, t in enumerate(texts)] + [(2, "again", 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in B.round_trip(df, FILE).collect()), key=str)
    assert got == sorted(((d, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, *_ in rows), key=str)
    back = B.decode(B.round_trip(df.where("text = 'one two'"), FILE), FILE).collect()
    assert {r["text"] for r in back} == {"one two"}
    assert B.digest(df.limit(0), FILE).collect() == []


def test_query_against_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op11_bpe_automaton(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
