import random

import numpy as np
import pytest

from evidentia.llm import decontam as D

DOCS = "doc_id long, text string, item_id long, score double"
ITEMS = "item_id long, text string, doc_id long"


class Numbers(dict):
    def __missing__(self, w):
        self[w] = len(self) + 1
        return self[w]


NUMBER = Numbers()


def coded(w):
    return np.array([NUMBER[x] for x in w], np.int64)


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best / (D.MATCH * len(a))


@pytest.mark.parametrize("seed", range(5))
def test_alignment_against_the_plain_matrix(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = rng.choices("abcdef", k=rng.randint(1, 15))
        b = rng.choices("abcdefg", k=rng.randint(1, 40))
        score, lo, hi = D.align(coded(a), coded(b))
        assert score == brute_align(a, b) and (not score or brute_align(a, b[lo:hi]) == score)


def vocabulary(n):
    rng = random.Random(1)
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def test_copies_edited_copies_and_clean_texts(spark):
    rng, v = random.Random(2), vocabulary(2000)
    items = {i: rng.choices(v, k=30) for i in range(25)}
    noise = lambda: " ".join(rng.choices(v, k=80))
    edit = lambda w: " ".join(x if rng.random() > 0.12 else rng.choice(v) for x in w)
    docs = [(i, f"{noise()} {' '.join(w).upper()}, {noise()}") for i, w in items.items()] + [(100 + i, f"{noise()} {edit(w)} {noise()}") for i, w in items.items()] + [(200 + i, noise()) for i in range(50)]
    docs += [(300, f"{noise()} {' '.join(items[3][:8])} {noise()}"), (301, f"{' '.join(items[0])} {noise()} {' '.join(items[1])}")]
    d = spark.createDataFrame([(i, t, 1, 1.0) for i, t in docs], DOCS)
    got = D.contamination(d, spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()], ITEMS)).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs == {(i, i) for i in items} | {(100 + i, i) for i in items} | {(301, 0), (301, 1)}
    texts = dict(docs)
    for r in got:
        if r["doc_id"] < 25:
            assert r["score"] == 1.0 and D.words(texts[r["doc_id"]][r["start"] : r["end"]]) == items[r["item_id"]]


def test_seeds_outnumber_what_an_accepted_alignment_can_break():
    """Every edited copy worth THRESHOLD keeps a pair that is a seed, whatever the document counts."""
    rng = random.Random(3)
    for n in (4, 5, 7, 12, 30, 47, 49, 60, 100):
        item = [f"w{i}" for i in range(n)]
        own = D.grams(coded(item), 10**6)
        df = np.array([rng.randrange(5) for _ in own])
        seeds = {int(own[k]) for k in D.choose_seeds(own, df)}
        for _ in range(200):
            copy = [x if rng.random() > 0.3 else "edit" for x in item]
            if D.align(coded(item), coded(copy))[0] >= D.THRESHOLD:
                assert seeds & set(D.pairs(coded(copy), 10**6).tolist())


@pytest.mark.parametrize("every", [3, 4, 5, 8])
def test_densely_edited_copies_against_full_alignment(spark, every):
    """The whole query against Smith-Waterman of every item with every text."""
    rng, v = random.Random(every), vocabulary(3000)
    items = {i: rng.choices(v, k=rng.randint(15, 57)) for i in range(40)}
    noise = lambda: rng.choices(v, k=40)
    docs = [(i, " ".join(noise() + [x if k % every else rng.choice(v) for k, x in enumerate(w, 1)] + noise())) for i, w in items.items()] + [(100 + i, " ".join(noise())) for i in range(20)]
    got = {(r["doc_id"], r["item_id"]) for r in D.contamination(spark.createDataFrame([(i, t, 1, 1.0) for i, t in docs], DOCS), spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()], ITEMS)).collect()}
    want = {(i, j) for i, t in docs for j, w in items.items() if (s := D.align(coded(w), coded(t.split()))[0]) >= D.THRESHOLD or s * len(w) >= D.PASSAGE}
    assert len(want) >= 38 and got == want


def test_copies_with_inserted_and_dropped_words(spark):
    rng, v = random.Random(9), vocabulary(3000)
    items = {i: rng.choices(v, k=40) for i in range(30)}
    noise = lambda: rng.choices(v, k=40)
    more = lambda w: [y for k, x in enumerate(w, 1) for y in ([x, rng.choice(v)] if k % 5 == 0 else [x])]
    less = lambda w: [x for k, x in enumerate(w, 1) if k % 6]
    docs = [(i, " ".join(noise() + more(w) + noise())) for i, w in items.items()] + [(100 + i, " ".join(noise() + less(w) + noise())) for i, w in items.items()]
    got = {(r["doc_id"], r["item_id"]) for r in D.contamination(spark.createDataFrame([(i, t, 1, 1.0) for i, t in docs], DOCS), spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()], ITEMS)).collect()}
    want = {(i, j) for i, t in docs for j, w in items.items() if D.align(coded(w), coded(t.split()))[0] >= D.THRESHOLD}
    assert len(want) == 60 and got == want


def test_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 2)
    items = [(5, "alpha beta gamma delta epsilon", 1), (9, "one two", 1), (1, "zeta eta theta iota kappa lambda", 1), (2, None, 1), (3, "...", 1), (None, "alpha beta gamma delta", 1), (5, "zzz", 1)]
    docs = [(1, "x Alpha beta, gamma delta epsilon y", 1, 1.0), (2, None, None, None), (3, "", 1, 1.0), (None, "zeta eta theta iota kappa lambda", 1, 1.0), (4, "so one two go", 1, 1.0), (4, "so one two go", 1, 1.0), (6, "pad " * 60_000 + "zeta eta theta iota kappa lambda", 1, 1.0)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in D.contamination(d, b).collect())
    assert got == [(0, 1), (1, 5), (4, 9), (4, 9), (6, 1)]
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [2, 3]  # a null doc_id saves no contaminated text
    assert D.contamination(d, spark.createDataFrame([], ITEMS)).count() == 0
    assert D.contamination(spark.createDataFrame([], DOCS), b).count() == 0


def test_blocks_are_cut_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 30)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}", 1) for i in range(5)]
    docs = [(i, f"so alpha{i} beta{i} gamma{i} delta{i} epsilon{i} it is", 1, 1.0) for i in range(5)]
    got = D.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(5)]


def test_every_text_of_a_repeated_item_id(spark):
    items = [(7, f"first{k} second{k} third{k} fourth{k} fifth{k} sixth{k}", 1) for k in range(4)]
    docs = [(k, f"so {t} it is", 1, 1.0) for k, (_, t, _) in enumerate(items)] + [(9, "nothing of the kind here", 1, 1.0)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, items[0]], ITEMS)
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contamination(d, b).collect()) == [(k, 7) for k in range(4)]
    assert [r["doc_id"] for r in D.drop_contaminated(d, b).collect()] == [9]


def test_passages_of_long_items(spark):
    rng, v = random.Random(5), vocabulary(5000)
    item, noise = rng.choices(v, k=250), lambda: " ".join(rng.choices(v, k=80))
    docs = [(n, f"{noise()} {' '.join(item[40 : 40 + n])} {noise()}", 1, 1.0) for n in (20, 30, 50, 70, 100, 200)]
    got = {r["doc_id"]: r["score"] for r in D.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item), 1)], ITEMS)).collect()}
    assert set(got) == {50, 70, 100, 200} and 0.4 <= got[100] < 0.5
