"""Sentence retrieval: TF-IDF, BM25 and their hybrid, per (claim, document).

Every document is a corpus of its own: term statistics are grouped by
document, never global. Documents are dealt once; statistics, the meeting with
the claims and the choice of the best all happen where a document then lies
(`ranking`). For this the claims' terms go to all tasks, if a count finds them
few; otherwise terms and claims are joined, and shuffled again.
These are the scores of all pairs that share a term; `index` finds the best of
a corpus without them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import ranking
from evidentia.plans.storage import kept

K1, B, EPSILON = 1.5, 0.75, 0.25
TFIDF_SHARE = 0.4
DIGITS = 6


def sentences(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, sent_ix, sentence), junk sentences dropped, numbered from 0."""
    kept = F.filter(T.sentences(T.text("text")), lambda s: ~T.is_junk_sentence(s))
    return docs.select("doc_id", F.posexplode(kept).alias("sent_ix", "sentence"))


#: Rows of (claim, term) that are sent to all tasks, about 60 bytes each.
SENT_TERMS = 200_000
#: Rows of a batch that leaves a task.
OUT = 1 << 16


def claim_terms(claims: DataFrame, tokenize) -> DataFrame:
    """(claim_id, term, qf): how often each claim has each term."""
    terms = claims.where("claim_id is not null").select("claim_id", F.explode(tokenize(T.text("claim"))).alias("term"))
    return terms.groupBy("claim_id", "term").agg(F.count("*").alias("qf"))


def _met(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """postings with the claims that have their term."""
    few = terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    return postings.join(F.broadcast(terms) if few else terms, "term")


def _by_document(sents: DataFrame, tokenize) -> DataFrame:
    """(doc_id, sent_ix, t, len): the sorted terms of each sentence, dealt by document."""
    t = F.array_sort(tokenize(F.col("sentence")))
    return sents.repartition("doc_id").select("doc_id", "sent_ix", t.alias("t"), F.size(t).alias("len"))


def _postings(rows: DataFrame) -> DataFrame:
    """rows by distinct term, with f, its count in the sentence, in place of t."""
    each = rows.withColumn("term", F.explode(F.array_distinct("t")))
    return each.withColumn("f", F.size(F.filter("t", lambda x: x == F.col("term")))).drop("t")


def split_words(c: Column) -> Column:
    return T.words(F.lower(c))


def index_words(c: Column) -> Column:
    """Lower-case runs of two or more word characters that aren't stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(T.STOP))


def top_sentences(scored: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best positive rows per claim and document, ties to the later sentence; adds rank."""
    order = Window.partitionBy("claim_id", "doc_id").orderBy(F.desc(score), F.desc("sent_ix"))
    return scored.where(F.col(score) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _sent_terms(claims: DataFrame, *tokenizers) -> list[tuple[pa.Table, pa.Array] | None]:
    """For each tokenizer the claims' terms and the claims' ids, as all tasks get them; None where there are more than SENT_TERMS."""
    out = []
    for tokenize in tokenizers:
        rows = claim_terms(claims, tokenize).limit(SENT_TERMS + 1).toArrow()
        out.append((rows, rows["claim_id"].unique()) if len(rows) <= SENT_TERMS else None)
    known = [x for x in out if x is not None]
    if len(known) == len(out) > 1:  # one numbering of the claims for all
        ids = pa.concat_arrays([ids for _, ids in known]).unique()
        out = [(rows, ids) for rows, _ in known]
    return out


def _listed(docs: DataFrame, tokenizers: dict, claims: DataFrame, sent: list, run: Callable, columns: str, ix: bool = True) -> DataFrame:
    """(claim_id, doc_id, ... columns): what run yields for batches of whole documents as numbers of claims, numbers of documents and further columns."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast([(ranking.Terms.of(*x), x[1]) for x in sent])
    # documents are dealt and ordered as texts, then cut, so that each one's sentences follow each other
    rows = sentences(docs.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id"))
    rows = rows.select("doc_id", "sent_ix", "sentence", *[f(F.col("sentence")).alias(name) for name, f in tokenizers.items()])
    kinds = [f"{c} {claims.schema[c].dataType.simpleString() if c == 'claim_id' else docs.schema[c].dataType.simpleString()}" for c in ("claim_id", "doc_id")]
    names = ["claim_id", "doc_id", *([] if not ix else ["sent_ix"]), *[c.split()[0] for c in columns.split(", ")]]
    schema = ", ".join([*kinds, *(["sent_ix int"] if ix else []), columns])
    types = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    further = [types[c.split()[1]] for c in schema.split(", ")[2:]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids = [t for t, _ in data.value], data.value[0][1]
        for batch in ranking.documents(batches):
            b = ranking.Batch(batch)
            for claim, doc, *rest in run(b, batch, terms) if len(ids) else ():
                for at in range(0, len(claim), OUT):
                    cut = slice(at, at + OUT)
                    more = [x[cut] if isinstance(x, pa.Array) else pa.array(x[cut]).cast(t) for x, t in zip(rest, further)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(claim[cut])), b.ids.take(pa.array(doc[cut])), *more], names)

    return rows.mapInArrow(score, schema)


def _ranked(b: ranking.Batch, parts: Iterator[tuple]) -> Iterator[tuple]:
    for claim, cell, units, rank in parts:
        yield claim, b.cell_doc[cell], b.cell_ix[cell], units / 10**DIGITS, rank


def _bm25_rows(b: ranking.Batch, batch: pa.RecordBatch, terms: ranking.Terms, n: int) -> Iterator[tuple]:
    return ranking.bm25(batch.column("w"), b, terms, n, 10**DIGITS, K1, B, EPSILON)


def _tfidf_rows(b: ranking.Batch, batch: pa.RecordBatch, terms: ranking.Terms, n: int) -> Iterator[tuple]:
    return ranking.tfidf(batch.column("i"), b, terms, n, 10**DIGITS)


def bm25_postings(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, term, part): what a term of a sentence adds to its score each time a claim has the term.

    BM25 Okapi with k1 1.5, b 0.75; a negative idf becomes a quarter of the
    document's mean idf. Words are what stands between white space, in lower
    case. A document of one sentence has no positive part.
    """
    doc, term = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "term")
    rows = _by_document(sents, split_words).where("len > 0")
    rows = rows.withColumn("n", F.count("*").over(doc)).withColumn("avgdl", F.sum("len").over(doc) / F.col("n"))
    each = _postings(rows).withColumn("df", F.count("*").over(term))
    each = each.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    once = 1 / F.col("df")  # over its postings a term counts once
    each = each.withColumn("mean", F.sum(F.col("idf") * once).over(doc) / F.sum(once).over(doc))
    weight = F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf"))
    part = weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return each.select("doc_id", "sent_ix", "term", part.alias("part"))


def bm25_scores(claims: DataFrame, docs: DataFrame, sents: DataFrame | None = None) -> DataFrame:
    """(claim_id, doc_id, sent_ix, score) of the sentences that share a word with the claim."""
    hits = _met(bm25_postings(sentences(docs) if sents is None else sents), claim_terms(claims, split_words))
    return hits.groupBy("claim_id", "doc_id", "sent_ix").agg(T.floor_to(F.sum(F.col("qf") * F.col("part")), DIGITS).alias("score"))


def bm25(claims: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    (sent,) = _sent_terms(claims, split_words)
    if sent is None:
        return top_sentences(bm25_scores(claims, docs), n)
    return _listed(docs, {"w": split_words}, claims, [sent], lambda b, batch, terms: _ranked(b, _bm25_rows(b, batch, terms[0], n)), "score double, rank int")


def best_of_batches(claims: DataFrame, docs: DataFrame, n: int) -> DataFrame | None:
    """(claim_id, doc_id, sent_ix, score): of each batch of documents the n best for each claim by their best BM25 sentence (of equal ones the last), ties to the smaller doc_id.

    None for more claims than go to all tasks.
    """
    (sent,) = _sent_terms(claims, split_words)
    if sent is None:
        return None

    def run(b: ranking.Batch, batch: pa.RecordBatch, terms: list[ranking.Terms]) -> Iterator[tuple]:
        place = np.argsort(pc.sort_indices(b.ids).to_numpy())
        for claim, cell, units, _ in _bm25_rows(b, batch, terms[0], 1):
            order = np.lexsort((place[b.cell_doc[cell]], -units, claim))
            _, first, size = np.unique(claim[order], return_index=True, return_counts=True)
            take = order[np.arange(len(order)) - np.repeat(first, size) < n]
            yield claim[take], b.cell_doc[cell[take]], b.cell_ix[cell[take]], units[take] / 10**DIGITS

    return _listed(docs.where("doc_id is not null"), {"w": split_words}, claims, [sent], run, "score double")


def tfidf_scores(claims: DataFrame, docs: DataFrame, sents: DataFrame | None = None) -> DataFrame:
    """(claim_id, doc_id, sent_ix, score): cosine of claim and sentence, fitted per (claim, document).

    Smooth idf over the document's sentences and the claim; L2 norms.
    """
    doc, sent, term, pair = (Window.partitionBy(*k) for k in (["doc_id"], ["doc_id", "sent_ix"], ["doc_id", "term"], ["claim_id", "doc_id"]))
    rows = _by_document((sentences(docs) if sents is None else sents).where("doc_id is not null"), index_words)
    each = _postings(rows.withColumn("n", F.count("*").over(doc)).where("len > 0")).withColumn("df", F.count("*").over(term))
    # a term's weight depends on whether the claim has it: idf = ln((2 + n) / (1 + df + has)) + 1
    idf = lambda has: F.log((2 + F.col("n")) / (1 + F.col("df") + has)) + 1
    each = each.withColumn("alone", F.col("f") * idf(F.lit(0))).withColumn("shared", F.col("f") * idf(F.lit(1)))
    each = each.withColumn("s2", F.sum(F.col("alone") * F.col("alone")).over(sent))
    claim = claim_terms(claims, index_words)
    claim = claim.withColumn("q2", F.sum(F.col("qf") * F.col("qf")).over(Window.partitionBy("claim_id")))
    # the claim's norm in a document: over its postings a met term counts once; words the document lacks have df 0
    hits = _met(each, claim).groupBy("claim_id", "doc_id", "sent_ix", "n", "s2", "q2").agg(
        F.sum(F.col("shared") * F.col("qf") * idf(F.lit(1))).alias("dot"),
        F.sum(F.col("shared") * F.col("shared") - F.col("alone") * F.col("alone")).alias("change"),
        F.sum(F.pow(F.col("qf") * idf(F.lit(1)), F.lit(2)) / F.col("df")).alias("in2"),
        F.sum(F.col("qf") * F.col("qf") / F.col("df")).alias("inq"),
    )
    absent = F.log((2 + F.col("n")) / 2.0) + 1
    rest = F.round(F.col("q2") - F.sum("inq").over(pair))
    c2 = F.sum("in2").over(pair) + rest * absent * absent
    cosine = F.col("dot") / F.sqrt((F.col("s2") + F.col("change")) * F.col("c2"))
    return hits.withColumn("c2", c2).select("claim_id", "doc_id", "sent_ix", T.floor_to(cosine, DIGITS).alias("score"))


def tfidf(claims: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    (sent,) = _sent_terms(claims, index_words)
    if sent is None:
        return top_sentences(tfidf_scores(claims, docs), n)
    return _listed(docs.where("doc_id is not null"), {"i": index_words}, claims, [sent], lambda b, batch, terms: _ranked(b, _tfidf_rows(b, batch, terms[0], n)), "score double, rank int")


def hybrid(claims: DataFrame, docs: DataFrame, n: int = 5, texts: bool = True) -> DataFrame:
    """(claim_id, doc_id, sentence, sent_ix, tfidf_score, bm25_score, combined, rank); texts: with the sentence itself.

    Each retriever contributes its n best sentences; a missing side counts 0;
    combined = 0.4 tfidf + bm25. Equal sentences of a document are one row: of
    repeated TF-IDF rows the last counts, repeated BM25 rows add up. Ties: rows
    that TF-IDF found, by its rank, then the others by BM25's. The documents
    are cut into sentences once.
    """
    docs = docs.where("doc_id is not null")
    sent = _sent_terms(claims, index_words, split_words)
    if None in sent:
        rows = _joined_hybrid(claims, docs, n)
        return rows if texts else rows.drop("sentence")

    def run(b: ranking.Batch, batch: pa.RecordBatch, terms: list[ranking.Terms]) -> Iterator[tuple]:
        sides = [[], []]
        for side, rows in zip(sides, (_tfidf_rows(b, batch, terms[0], n), _bm25_rows(b, batch, terms[1], n))):
            side.extend(rows)
        t, s = (tuple(map(np.concatenate, zip(*x))) for x in sides)
        claim, row, ix, *rest, rank = ranking.fused(t, s, b, batch.column("sentence"), n, 10**DIGITS, TFIDF_SHARE)
        yield claim, b.doc[row], *([batch.column("sentence").take(pa.array(row))] if texts else []), ix, *rest, rank

    columns = f"{'sentence string, ' if texts else ''}sent_ix int, tfidf_score double, bm25_score double, combined double, rank int"
    return _listed(docs, {"i": index_words, "w": split_words}, claims, sent, run, columns, ix=False)


def _joined_hybrid(claims: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """hybrid for more claims than go to all tasks."""
    texts = kept(sentences(docs))
    found = top_sentences(tfidf_scores(claims, docs, texts), n).withColumn("by", F.lit("t")).unionByName(top_sentences(bm25_scores(claims, docs, texts), n).withColumn("by", F.lit("b")))
    t, b, zero = F.col("by") == "t", F.col("by") == "b", F.lit(0.0)
    rows = found.join(texts, ["doc_id", "sent_ix"]).groupBy("claim_id", "doc_id", "sentence").agg(
        F.min("sent_ix").alias("sent_ix"),
        F.coalesce(F.max_by(F.when(t, F.col("score")), F.when(t, F.col("rank"))), zero).alias("tfidf_score"),
        F.coalesce(F.sum(F.when(b, F.col("score"))), zero).alias("bm25_score"),
        F.coalesce(F.min(F.when(t, F.col("rank"))), F.lit(1_000) + F.min("rank")).alias("ord"),
    )
    rows = rows.withColumn("combined", T.floor_to(TFIDF_SHARE * F.col("tfidf_score") + F.col("bm25_score"), DIGITS))
    order = Window.partitionBy("claim_id", "doc_id").orderBy(F.desc("combined"), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("ord")
