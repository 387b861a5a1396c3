import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evidentia.llm import align as L
from evidentia.llm.bpe_automaton import byte_alphabet
from evidentia.llm.queries import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Brute:
    """Both libraries, spans compared pair by pair."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x(..)>", piece)) else piece.replace("▁", " ").encode()

    def links(self, text):
        if not text:
            return None
        sides = []
        for ids, of in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes.__getitem__), (self.b.encode(text), self.b_bytes)):
            if b"".join(map(of, ids)) != f" {text}".encode():
                return None
            ends = np.cumsum([len(of(i)) for i in ids]).tolist()
            sides.append(list(zip(ids, [0, *ends], ends)))
        a, b = sides
        pairs, j = [], 0
        for x, s, e in a:
            while b[j][2] <= s:
                j += 1
            pairs += [(x, y) for y, s2, e2 in b[j : j + e - s] if s2 < e and e2 > s]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ["|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in sides) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 3000 else None
        return a, b, pairs, cuts, groups

    def rows(self, texts):
        found = [self.links(t) for t in texts]
        count = Counter(p for f in found if f for p in set(f[2]))
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        for f in found:
            if f is None:
                yield (0,) * 6 + ("",)
            else:
                a, b, pairs, cuts, groups = f
                yield (len(a), len(b), len(cuts), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), groups and hashlib.sha256(";".join(groups).encode()).hexdigest())


TEXTS = [
    None, "", " ", "  ", "a", "hello  world ", "▁a", "x ▁", "<s> </s> <unk> <0x41> <|endoftext|>", "\n\n\t x\r", "é ﬁ Ａ 日本語 \U0001F600", "\x00 \x1c\xa0", "tokenization of unbelievable words", "tokenization of unbelievable words",
    "the the the the", "1234567890 12 345", "=" * 500, " " * 400, "don't I'll x'S", "\U00018d09 z", "a" * 5000,
]


@pytest.mark.parametrize("hot", [L.HOT, 40, 0])
def test_rows_against_brute_force(spark, hot):
    """All pairs of ids sent to the tasks, some, or none."""
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(TEXTS)] + [(5, "a", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, pairs string").repartition(3)
    got = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in L.digest(df, A, B, hot=hot).collect())
    want = Counter((i, *x) for (i, *_), x in zip(rows, Brute().rows([r[1] for r in rows])))
    assert got == want


def test_bitsets():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randrange(1, 400)
        sides = [sorted({*rng.sample(range(1, size + 1), rng.randrange(size)), size}) for _ in range(2)]
        a_to, b_to, link_a, link_b = L.align(*(np.diff(x, prepend=0) for x in sides))
        spans = [list(zip([0, *x], x)) for x in sides]
        assert list(zip(link_a.tolist(), link_b.tolist())) == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        shared = sorted(set(sides[0]) & set(sides[1]))
        assert (a_to.tolist(), b_to.tolist()) == ([sides[0].index(c) + 1 for c in shared], [sides[1].index(c) + 1 for c in shared])
    assert [len(x) for x in L.align(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0, 0]


def test_pieces_equal_the_model():
    p, rng = L.Pieces(B), random.Random(2)
    assert p.parted
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "\x00", "日", "7", "==", "ing"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    assert [p.encode(t) for t in texts] == p.model.encode(texts)
    assert [p.encode(t) for t in texts] == p.model.encode(texts)  # from memory


def test_groups_are_shown(spark):
    row = L.alignments(spark.createDataFrame([(1, "unbelievable")], "doc_id long, text string"), A, B).first()
    a, b, pairs, _, groups = Brute().links("unbelievable")
    assert row["groups"] == ";".join(groups) and sum(row["times"]) == row["n_links"] == len(pairs)
    assert [(p >> L.B_BITS, p & (1 << L.B_BITS) - 1) for p in row["pairs"]] == sorted(set(pairs))


def test_empty_table(spark):
    assert L.digest(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    want = {r["doc_id"]: x for r, x in zip(docs, Brute().rows([r["text"] for r in docs]))}
    assert len(got) == len(docs)
    assert {d: x[:6] for d, x in got.items()} == {d: x[:6] for d, x in want.items()}
    assert all(got[d][6] == x[6] for d, x in want.items() if x[6] is not None)


def test_parts_are_remembered():
    """Texts put together from remembered parts are those aligned whole, at any kind of white space; a part is encoded once."""
    rng = random.Random(3)
    bits = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x1c", "\x85", " ", "　", "a", "word", "é", "日本", "'s", "12", "...", "​", "﻿", "ﬁ", "Ａ", "\U00018d09", "▁", "\x00"]
    texts = ["".join(rng.choices(bits, [1 + (i < 4) * 9 + (11 < i < 19) * 4 for i in range(len(bits))], k=rng.randrange(12))) for _ in range(4000)]
    both = L._Pair(A, B)
    groups, sizes, doc, pair = both.aligned(texts)
    whole, want, pairs = both.found([both.ids(t) or ((), ()) for t in texts])
    assert groups == [g[:-1] for g in whole] and (sizes == want).all() and (pair == pairs).all() and (doc == np.repeat(np.arange(len(texts)), want[:, 3])).all()
    assert (sizes[:, 0] > 0).sum() > 2000
    plain = [t for t in texts if t.isascii() and "\x00" not in t]
    both.a = both.b.model = None
    assert both.aligned(plain)[0] == [g for g, t in zip(groups, texts) if t in set(plain)]
