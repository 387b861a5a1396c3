import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np

from evidentia.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, score double, terms string, id long"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        own = rng.choices(words, k=30) + (rng.choices(["nastyone", "vilething", "grimword", "blech"], k=4) if toxic else [])
        rng.shuffle(own)
        docs.append((i, " ".join(own), "en", 1.0, "x", i))
        labels.append((i, 1, int(toxic), "x"))
    return docs, labels


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus()
    got = X.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {r[0]: r[2] for r in labels}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(zlib.crc32(str(e["doc_id"]).encode()) % 4 != 2 for r in got for e in r["evidence"])


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(200)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, q, t, x in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = ({r["doc_id"]: r["score"] for r in X.score_toxicity(d, spark.createDataFrame(y, LABELS)).collect()} for y in (labels, other))
    assert a == b


def test_index_finds_the_exact_neighbours(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    monkeypatch.setattr(X, "AHEAD", 2)
    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 5, 30)
    examples = []
    for i in range(300):
        terms = np.sort(rng.choice(30, rng.integers(0, 6), replace=False))
        examples.append((i, int(rng.integers(0, 2)), terms, rng.integers(1, 4, len(terms))))
    ix = X.Index.build(examples, idf)
    dense = np.zeros((300, 30))
    for i, _, t, c in examples:
        dense[i, t] = X.weigh(t, c, idf)
    for _ in range(200):
        t = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        c = rng.integers(1, 3, len(t))
        q = np.zeros(30)
        q[t] = X.weigh(t, c, idf)
        want = np.sort(dense @ q)[::-1][: X.NEIGHBOURS]
        got = ix.nearest(t, c)
        assert np.allclose([s for s, _ in got], want[want > 0][: len(got)]) and len(got) == min(X.NEIGHBOURS, int((want > 0).sum()))
        assert all(math.isclose(s, float(dense[ix.ids[i]] @ q)) for s, i in got)


def test_whole_query_against_dense_vectors(spark):
    """Scores of the query from plain dictionaries: every word is a term, df over all documents, cosine to every example."""
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    words, ix, _ = X.fitted(d, y)
    texts = dict(rows)
    marked = words.marked
    vectors, df = {}, Counter()
    for i, t in rows:
        vectors[i] = {k: n for k, n in X.features(X.word_counts(t)).items() if k in marked or not k.startswith("^")}
        df.update(vectors[i].keys())
    own = [vectors[i] for i in ix.ids]
    known = set().union(*own, marked)

    def cosines(q):
        def weights(v):
            w = {k: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[k])) + 1) * (1 if k in marked else X.REST) for k, n in v.items() if k in known}
            size = math.sqrt(sum(x * x for x in w.values()))
            return {k: x / size for k, x in w.items()} if w else {}

        q = weights(q)
        return [sum(x * q.get(k, 0.0) for k, x in weights(e).items()) for e in own]

    got = {r["doc_id"]: r for r in X.score_toxicity(d, y).collect()}
    assert sum(not r["evidence"] for r in got.values()) <= 0.01 * len(rows)
    for i in sorted(texts)[::40]:
        s = cosines(vectors[i])
        order = sorted(range(len(s)), key=lambda j: (-s[j], j))[: X.NEIGHBOURS]
        w = [s[j] ** 2 for j in order if s[j] > 0]
        vote = (sum(a for a, j in zip(w, order) if ix.toxic[j]) + X.PULL * ix.share) / (sum(w) + X.PULL)
        a, b = ix.curve
        if w and (len(s) <= X.NEIGHBOURS or s[order[-1]] - sorted(s)[-X.NEIGHBOURS - 1] > 1e-9):  # no tie at the end
            assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-(a * X.logit(vote) + b))), abs_tol=1e-6)


def test_scores_are_calibrated_on_held_out_rows(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in X.score_toxicity(d, y).where("held_out").collect()}
    truth = dict(duckdb.sql("select doc_id, max(toxic) from '/root/testdata/sf0.1/labels.parquet' group by 1").fetchall())
    pairs = [(got[i]["score"], t) for i, t in truth.items() if i in got]
    for lo, hi in ((0, 0.3), (0.3, 0.9), (0.9, 1.01)):
        band = [p for p in pairs if lo <= p[0] < hi]
        assert len(band) > 20 and abs(sum(s for s, _ in band) - sum(t for _, t in band)) <= 0.1 * len(band)
    found = sum(t for s, t in pairs if s >= X.THRESHOLD)
    assert found >= 0.9 * sum(t for _, t in pairs) and sum(1 - t for s, t in pairs if s >= X.THRESHOLD) <= 0.02 * len(pairs)


def test_bounds_of_the_examples(monkeypatch):
    rows = [(i, int(i % 7 == 0), 10 + i) for i in range(1000)]
    chosen, curve = X.choose_examples(rows)
    assert len(curve) == 200 and sorted(chosen + curve) == list(range(1000))
    monkeypatch.setattr(X, "EXAMPLES", 100)
    chosen, curve = X.choose_examples(rows)
    assert len(chosen) == 100 and sum(i % 7 == 0 for i in chosen) == 50 and not set(chosen) & set(curve)
    monkeypatch.setattr(X, "CHARS", 1000)
    sizes = {i: n for i, _, n in rows}
    assert 0 < sum(sizes[i] for i in X.choose_examples(rows)[0]) <= 1000
    assert X.choose_examples([]) == ([], [])


def test_repeated_ids_score_their_own_texts(spark):
    docs, labels = corpus(200)
    nasty = "nastyone vilething grimword blech"
    docs += [(1000, nasty, "en", 1.0, "x", 1), (1000, docs[1][1], "en", 1.0, "x", 1), (6, nasty, "en", 1.0, "x", 1), (6, docs[1][1], "en", 1.0, "x", 1)]
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    a, b = (sorted((r["doc_id"], r["score"]) for r in X.score_toxicity(x, y).collect()) for x in (d, d.repartition(7)))
    assert a == b and sorted(s >= 0.3 for i, s in a if i == 1000) == [False, True]


def test_edges(spark):
    docs, labels = corpus(120)
    docs += [(None, "nastyone vilething", "en", 1.0, "x", 1), (500, None, None, None, None, None), (501, "", "en", 1.0, "x", 1), (502, "nastyone " * 50_000, "en", 1.0, "x", 1), (0, docs[0][1], "en", 1.0, "x", 1)]
    labels += [(None, 1, 1, "x"), (7, 1, None, "x"), (999, 1, 1, "x"), (12, 1, 0, "x")]
    d = spark.createDataFrame(docs, DOCS)
    got = X.score_toxicity(d, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert by[500]["score"] == by[501]["score"] < 0.3 and by[500]["evidence"] == [] and by[502]["predicted"] == 1
    kept = X.drop_toxic(d, spark.createDataFrame(labels, LABELS))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == d.columns and {500, 501} <= set(ids) and 502 not in ids and None not in ids
    none = X.score_toxicity(d, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert X.score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0
