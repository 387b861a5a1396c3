"""Search over the corpus behind a cache, in place of a web search."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import hashing as H
from evidentia.functions import text as T
from evidentia.operators import index
from evidentia.operators.retrieval import sentences
from evidentia.plans.storage import kept

TTL_SECONDS = {"search": 86_400, "document": 86_400, "social": 43_200}


class SearchProvider(ABC):
    """(query_id, query) -> (query_id, rank, url, title, snippet), best first."""

    name: str

    @abstractmethod
    def search(self, queries: DataFrame, num_results: int = 5) -> DataFrame: ...


class CorpusProvider(SearchProvider):
    """Ranks documents (doc_id, text, url, title) by their best BM25 sentence, which is the snippet.

    An index that was built beforehand is read as far as the queries need it.
    Without one a search scans the corpus, which takes no more disk than its
    texts; only queries of too many words for that build an index, which stays.
    """

    name = "corpus"

    def __init__(self, documents: DataFrame, built: index.Index | None = None) -> None:
        self.documents = documents
        self.built = built

    def search(self, queries: DataFrame, num_results: int = 5) -> DataFrame:
        claims = queries.select(F.col("query_id").alias("claim_id"), F.col("query").alias("claim"))
        top = index.scan(claims, self.documents, num_results) if self.built is None else None
        if top is not None:
            top = kept(top)
            texts = sentences(self.documents.select("doc_id", "text").join(top.select("doc_id").distinct(), "doc_id", "left_semi"))
        else:
            self.built = self.built or index.build(self.documents)
            top = index.search(self.built, claims, num_results)
            texts = self.built.sentences.select("doc_id", "sent_ix", "sentence")
        found = top.join(texts, ["doc_id", "sent_ix"]).join(self.documents.select("doc_id", "url", "title"), "doc_id")
        return found.select(F.col("claim_id").alias("query_id"), "rank", "url", "title", F.col("sentence").alias("snippet"))


def page_size(n: Column) -> Column:
    """Requested results, 1 to 20, 10 if not given."""
    return F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce(n, F.lit(10))))


def request_reject(text: Column, most: int = 10_000) -> Column:
    """Null for a usable request text, else blank or too long."""
    return F.when(T.strip(T.text(text)) == "", "422:blank").when(F.length(text) > most, "422:long")


def cached(queries: DataFrame, cache: DataFrame, provider: str, now: Column, num_results: int = 5) -> DataFrame:
    """queries (query_id, query) -> adds hit and results (first num_results) from live cache rows (key, results, expires_at)."""
    keyed = queries.withColumn("key", H.cache_key(F.lit(provider), F.col("query")))
    live = cache.where(F.col("expires_at") > now).groupBy("key").agg(F.max_by("results", "expires_at").alias("found"))
    joined = keyed.join(live, "key", "left")
    return joined.withColumn("hit", F.col("found").isNotNull()).withColumn("results", F.slice("found", 1, num_results)).drop("found")


def cache_rows(results: DataFrame, provider: str, now: Column, kind: str = "search") -> DataFrame:
    """results (query, results) -> cache rows; empty results aren't cached."""
    some = results.where(F.size("results") > 0)
    return some.select(H.cache_key(F.lit(provider), F.col("query")).alias("key"), "results", (now + F.make_interval(secs=F.lit(TTL_SECONDS[kind]))).alias("expires_at"))
