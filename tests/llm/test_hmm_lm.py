import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import hmm_lm as M

DOCS = "doc_id long, text string, n_tokens long, word string, rid long"


def model(rng, k, symbols):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return M.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, symbols))).T.copy())


def texts(rng, symbols, n=9):
    return [rng.integers(0, symbols, rng.integers(1, 7)).astype(np.uint16) for _ in range(n)]


def paths(m, doc):
    """All state paths of a text and their probabilities."""
    import itertools

    for p in itertools.product(range(len(m.start)), repeat=len(doc)):
        x = m.start[p[0]] * m.emit[doc[0], p[0]]
        for a, b, o in zip(p, p[1:], doc[1:]):
            x *= m.move[a, b] * m.emit[o, b]
        yield p, x


@pytest.mark.parametrize("group", [3, 400_000])
def test_forward_and_expected_counts_against_all_paths(monkeypatch, group):
    monkeypatch.setattr(M, "_GROUP", group)
    rng = np.random.default_rng(1)
    m, k, symbols = model(rng, 3, 5), 3, 5
    docs = texts(rng, symbols)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    for d, got in zip(docs, M.log10_likelihood(m, docs)):
        every = list(paths(m, d))
        total = sum(x for _, x in every)
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)
        for p, x in every:
            start[p[0]] += x / total
            for a, b in zip(p, p[1:]):
                move[a, b] += x / total
            for o, s in zip(d, p):
                emit[o, s] += x / total
    for a, b in zip(M.expected_counts(m, docs), (start, move, emit)):
        assert np.allclose(a, b)


def test_likelihoods_sum_to_one():
    m = model(np.random.default_rng(3), 2, 3)
    every = [np.array([a, b, c], np.uint16) for a in range(3) for b in range(3) for c in range(3)]
    assert math.isclose(sum(10 ** M.log10_likelihood(m, every)), 1.0)


def corpus(n=150):
    rng, out = random.Random(4), []
    kinds = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    for i in range(n):
        out.append((i, " ".join(rng.choices(kinds[i % 3], k=40)) + f" Rare{rng.randint(0, 60)}", 1, "x", 1))
    return out


def test_query_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(M, "CLASSES", 50)  # so that the join of rare words has much to do
    rows = [*corpus(), (900, None, 1, "x", 1), (901, "", 1, "x", 1), (None, "a1 b2 unseen", None, None, None), (902, "never seen\x0bwords here", 1, "x", 1), (903, "A1 a1 " * 20_000, 1, "x", 1), (5, "a1", 1, "x", 1)]
    got = M.score_texts(spark.createDataFrame(rows, DOCS)).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), b"\0"]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not fold(r[0]) for w in tok(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), fold(r[0]), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for r in rows for w in [tok(r[1])])
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)


def test_tables_without_training_rows(spark):
    assert M.score_texts(spark.createDataFrame([], DOCS)).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = M.score_texts(spark.createDataFrame([(alone, "some words", 1, "x", 1)], DOCS)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and abs(r["score"]) < 1e-9


def test_frequent_words_have_no_cliff(spark, monkeypatch):
    rows = [(f"w{i}".encode(), 1) for i in range(66_000)] + [(b"the", 90), (b"of", 80), (b"x" * 300, 70)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    top = M.frequent_words(counts)
    assert len(top) == M.CLASSES and [bytes(r["word"]) for r in top[:2]] == [b"the", b"of"]
    assert {bytes(r["word"]) for r in M.frequent_words(counts.repartition(5))} == {bytes(r["word"]) for r in top}
    monkeypatch.setattr(M, "CLASSES", 70_000)
    assert len(M.frequent_words(counts)) == 66_002
    monkeypatch.setattr(M, "CLASSES", 1)
    assert [bytes(r["word"]) for r in M.frequent_words(counts)] == [b"the"]


def test_very_long_texts_in_slices(monkeypatch):
    rng = np.random.default_rng(6)
    m = model(rng, 4, 9)
    docs = [rng.integers(0, 9, n).astype(np.uint16) for n in (3, 50, 1, 101)]
    whole = M.log10_likelihood(m, docs)
    monkeypatch.setattr(M, "_GROUP", 7)
    assert np.allclose(M.log10_likelihood(m, docs), whole, rtol=1e-12)


def test_whole_query_with_one_state_is_a_smoothed_unigram(spark, monkeypatch):
    """With one state the posterior is 1, so the query's score has a closed form."""
    monkeypatch.setattr(M, "STATES", 1)
    monkeypatch.setattr(M, "CLASSES", 30)
    monkeypatch.setattr(M.seeded, "__defaults__", (1, 2))
    rows = [*corpus(60), (900, "a1 never seen", 1, "x", 1)]
    got = {r["doc_id"]: r for r in M.score_texts(spark.createDataFrame(rows, DOCS)).collect()}
    tok = lambda t: [*t.encode().lower().split(), M.END]
    c = Counter(w for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 for w in tok(r[1]))
    n, total = sum(c.values()), sum(c.values()) + len(c) + 1
    counts = spark.createDataFrame(list(c.items()), "word binary, c long")
    top = {bytes(r["word"]) for r in M.frequent_words(counts)}
    base = {w: (c[w] + 1) / total for w in top}
    rest, seen = 1 - sum(base.values()), n - sum(c[w] for w in top)
    for i, t, *_ in rows:
        want = 0.0
        for w in tok(t):
            if w in top:
                want += math.log10((c[w] + M.SMOOTH * base[w]) / (n + M.SMOOTH))
            else:
                want += math.log10((seen + M.SMOOTH * rest) / (n + M.SMOOTH) * ((c[w] + 1) / total) / rest)
        assert math.isclose(got[i]["score"], want, rel_tol=1e-5)
