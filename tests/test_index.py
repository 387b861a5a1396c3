import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import index as X
from evidentia.operators import retrieval as R
from evidentia.sources import search


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences of a skewed vocabulary, one word in most of them; some passages in many documents; repeated ids, nulls and empty texts."""
    rng = random.Random(4)
    words = ["the"] * 30 + [f"w{i}" for i in range(200) for _ in range(1 + 60 // (i + 1))]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 14))).capitalize() + "."
    passages = [sentence() for _ in range(12)]
    docs = [(i, " ".join(rng.choice(passages) if rng.random() < 0.05 else sentence() for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    docs += [(3, "Again the third document has w1 and w150 here. And one more sentence about the w2 thing."), (None, sentence()), (500, None), (501, "")]
    claims = [(i, p) for i, p in enumerate(passages)] + [(20 + i, sentence()) for i in range(10)] + [(90, None), (91, ""), (92, "unknown words only"), (93, "the"), (94, "the the the w1")]
    return spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def built(corpus):
    return X.build(corpus[1])


def brute(claims, docs, n):
    best = R.bm25_scores(claims, docs.where("doc_id is not null")).where("score > 0").groupBy("claim_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "doc_id")
    return {tuple(r) for r in best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("claim_id", "doc_id", "score", "rank").collect()}


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_search_is_exact(corpus, built, n):
    claims, docs = corpus
    got = X.search(built, claims, n).select("claim_id", "doc_id", "score", "rank")
    assert {tuple(r) for r in got.collect()} == brute(claims, docs, n)


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_any_unread_share_is_exact(corpus, built, share, monkeypatch):
    monkeypatch.setattr(X, "UNREAD", share)
    got = X.search(built, corpus[0], 3).select("claim_id", "doc_id", "score", "rank")
    assert {tuple(r) for r in got.collect()} == brute(*corpus, 3)


def test_build_keeps_no_table_but_the_index(corpus, monkeypatch):
    """Sentences and postings aren't written beside the index that is made of them."""

    def none(df):
        raise AssertionError("a table beside the index")

    monkeypatch.setattr(X, "kept", none)
    assert X.build(corpus[1]).blocks.count() > 0


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_tables_too_large_to_send_are_exact(corpus, sent, monkeypatch):
    for name in ("SENT_ROWS", "SENT_LEVELS"):
        monkeypatch.setattr(X, name, sent)
    monkeypatch.setattr(X, "BLOCK", 32)
    got = X.search(X.build(corpus[1]), corpus[0], 3).select("claim_id", "doc_id", "score", "rank")
    assert {tuple(r) for r in got.collect()} == brute(*corpus, 3)


def test_what_is_read(corpus, built):
    """Most postings of a claim's words are left unread, and of what is read few sentences are scored."""
    claims = corpus[0].where("claim_id < 12")
    _, wanted = X.plan(built, claims, 1)
    read = wanted.agg(F.sum("size")).first()[0]
    there = R.claim_terms(claims, R.split_words).join(built.levels, "term").agg(F.sum("size")).first()[0]
    assert read < 0.5 * there
    assert X.candidates(built, wanted).count() < 0.25 * read


def test_blocks_are_even(corpus, spark, monkeypatch):
    """A term of most sentences is many rows of bounded size."""
    monkeypatch.setattr(X, "BLOCK", 32)
    built = X.build(corpus[1])
    sizes = built.blocks.where("term = 'the'").select(F.size("postings").alias("n")).collect()
    assert len(sizes) > 10 and max(r["n"] for r in sizes) < 3 * 32
    got = X.search(built, corpus[0], 5).select("claim_id", "doc_id", "score", "rank")
    assert {tuple(r) for r in got.collect()} == brute(*corpus, 5)


def test_reopened_and_provider(corpus, built, spark):
    claims, docs = corpus
    again = X.open_index(spark, built.path)
    want = {tuple(r) for r in X.search(built, claims, 2).collect()}
    assert {tuple(r) for r in X.search(again, claims, 2).collect()} == want
    pages = docs.where("doc_id < 100 and text is not null and doc_id != 3").withColumn("url", F.concat(F.lit("u"), "doc_id")).withColumn("title", F.lit("t"))
    provider = search.CorpusProvider(pages, X.build(pages))
    got = provider.search(claims.select(F.col("claim_id").alias("query_id"), F.col("claim").alias("query")), 2).collect()
    assert {(r["query_id"], int(r["url"][1:]), r["rank"]) for r in got} == {(c, d, k) for c, d, _, k in brute(claims, pages, 2)}


def test_empty_corpus(corpus, spark):
    assert X.best_documents(corpus[0], corpus[1].limit(0)).collect() == []


def test_pairs_with_many_claims(corpus, monkeypatch):
    """Beyond the bound claims and terms are joined: the same scores."""
    claims, docs = corpus[0], corpus[1].where("doc_id != 3")
    want = {tuple(r) for r in R.hybrid(claims, docs, n=2).collect()}
    monkeypatch.setattr(R, "SENT_TERMS", 0)
    assert {tuple(r) for r in R.hybrid(claims, docs, n=2).collect()} == want


def test_pairs_are_scored_where_documents_lie(corpus, spark, monkeypatch):
    """Only documents are shuffled, once; documents that span batches give the joined form's rows."""
    claims, docs = corpus
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {}
        for f in (R.hybrid, R.bm25, R.tfidf):
            # sentences that share an id and a number tie in the hybrid's order
            df = f(claims, docs.where("doc_id != 3") if f is R.hybrid else docs, 2)
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("Exchange") <= 1 and "Join" not in plan and "Window" not in plan
            got[f] = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(R, "SENT_TERMS", 0)
    for f, rows in got.items():
        df = f(claims, docs.where("doc_id != 3") if f is R.hybrid else docs, 2)
        names = [c for c in sorted(df.columns) if c in ("claim_id", "doc_id", "sent_ix", "score", "rank", "sentence", "tfidf_score", "bm25_score", "combined")]
        assert len(rows) > 100 and rows == sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_claims_in_parts(corpus, monkeypatch):
    """Claims that are taken a few at a time give the same rows."""
    claims, docs = corpus
    batch = R.sentences(docs.orderBy("doc_id")).select("doc_id", "sent_ix", R.split_words(F.col("sentence")).alias("w"), R.index_words(F.col("sentence")).alias("i")).toArrow().combine_chunks().to_batches()[0]
    i, w = (R.ranking.Terms.of(*x) for x in R._sent_terms(claims, R.index_words, R.split_words))
    b = R.ranking.Batch(batch)

    def rows():
        parts = [[tuple(zip(*map(list, p))) for p in f(b, batch, t, 2)] for f, t in ((R._tfidf_rows, i), (R._bm25_rows, w))]
        return [len(p) for p in parts], [sorted(r for p in part for r in p) for part in parts]

    whole, want = rows()
    monkeypatch.setattr(R.ranking, "CELLS", 20_000)
    many, got = rows()
    assert whole == [1, 1] and min(many) > 2 and got == want


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_scan_is_exact(corpus, built, n):
    claims, docs = corpus
    assert sorted(map(tuple, X.scan(claims, docs, n).select("claim_id", "doc_id", "sent_ix", "score", "rank").collect())) == sorted(map(tuple, X.search(built, claims, n).select("claim_id", "doc_id", "sent_ix", "score", "rank").collect()))


def test_a_search_without_index_builds_none(corpus, built, monkeypatch):
    claims, docs = corpus
    docs, queries = docs.withColumn("url", F.col("doc_id").cast("string")).withColumn("title", F.lit("t")), claims.toDF("query_id", "query")
    want = sorted(map(tuple, search.CorpusProvider(docs, built).search(queries, 3).collect()))

    def none(docs):
        raise AssertionError("an index of the whole corpus")

    monkeypatch.setattr(X, "build", none)
    assert sorted(map(tuple, search.CorpusProvider(docs).search(queries, 3).collect())) == want


def test_one_search_over_a_corpus_builds_no_index(corpus, monkeypatch):
    """best_documents scans; only claims of too many words for that get an index."""
    want = {n: brute(*corpus, n) for n in (1, 5)}
    build, made = X.build, []
    monkeypatch.setattr(X, "build", lambda docs: made.append(1) or build(docs))
    for n, rows in want.items():
        assert {tuple(r) for r in X.best_documents(*corpus, n).collect()} == rows and not made
    monkeypatch.setattr(R, "SENT_TERMS", 0)
    assert {tuple(r) for r in X.best_documents(*corpus, 5).collect()} == want[5] and made
