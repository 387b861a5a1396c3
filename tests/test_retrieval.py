import math

import duckdb
import pytest

from evidentia.operators import retrieval as R

CLAIM = "The shark was swimming in Delhi roads."
DOC = "It was a sunny day in Mumbai. Suddenly, a shark was spotted swimming through the flooded roads in Delhi. People were shocked by the shark. The water level was very high in the city."


@pytest.fixture
def shark(spark):
    return spark.createDataFrame([(1, CLAIM)], "claim_id long, claim string"), spark.createDataFrame([(1, DOC)], "doc_id long, text string")


def test_golden_scores(shark):
    bm = {r["sent_ix"]: r["score"] for r in R.bm25_scores(*shark).collect()}
    assert bm == {0: 0.336295, 1: 1.821472, 2: 0.178408, 3: 0.518638}
    tf = {r["sent_ix"]: r["score"] for r in R.tfidf_scores(*shark).collect()}
    assert math.isclose(tf[1], 0.666764, abs_tol=2e-6) and math.isclose(tf[2], 0.184971, abs_tol=2e-6)


def test_hybrid_keeps_two(shark):
    got = {r["rank"]: r for r in R.hybrid(*shark, n=2).collect()}
    assert len(got) == 2 and "shark was spotted swimming" in got[1]["sentence"] and math.isclose(got[1]["combined"], 2.088178, abs_tol=2e-6)
    assert got[2]["sentence"].startswith("The water level") and got[2]["tfidf_score"] == 0


def test_edges(spark):
    claims = spark.createDataFrame([(1, CLAIM), (2, None), (3, ""), (None, CLAIM)], "claim_id long, claim string")
    docs = spark.createDataFrame([(1, "Only one sentence about a shark in Delhi."), (2, None), (3, "")], "doc_id long, text string")
    assert R.bm25(claims, docs).count() == 0
    assert {(r["claim_id"], r["doc_id"]) for r in R.tfidf(claims, docs).collect()} == {(1, 1)}
    assert R.hybrid(claims, docs.limit(0)).count() == 0


def test_bm25_against_plain_python(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by 1").fetchall()
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet' order by 1").fetchall()
    claims = spark.createDataFrame(items, "claim_id long, claim string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["claim_id"], r["doc_id"], r["sent_ix"]): r["score"] for r in R.bm25_scores(claims, docs).collect()}
    sents: dict = {}
    for r in R.sentences(docs).collect():
        sents.setdefault(r["doc_id"], {})[r["sent_ix"]] = r["sentence"].lower().split()
    n = 0
    for d, own in sents.items():
        df: dict = {}
        for w in own.values():
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        size, avg = len(own), sum(map(len, own.values())) / len(own)
        idf = {t: math.log(size - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
        mean = sum(idf.values()) / len(idf)
        idf = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
        for c, text in items[:10]:
            q = text.lower().split()
            for i, w in own.items():
                if set(q) & set(w):
                    s = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in q if t in w)
                    assert abs(got[(c, d, i)] - s) < 2e-6
                    n += 1
    assert n > 1000
