"""A persisted inverted index over a corpus, and exact top-k search in it by score bounds.

Postings are BM25 parts (of a term of a sentence, fitted to its document). A
term's postings stand in blocks of about BLOCK, all of one level, a step of
their part; a block's bound is its largest part. So a term of any frequency is
many rows of even size, and a search chooses levels without reading postings.

A search first reads blocks of a query's rarest terms and scores their
sentences whole. The k-th best document found this way is a threshold. Then,
of each term, levels from the lowest up are left unread, where they hold most
postings for the score they can add, as long as all that is left unread adds
up to a share of the threshold at most. A sentence that can reach it stands in
what is read, with terms that make up the rest by their bounds; only such
sentences are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import retrieval as R
from evidentia.plans.storage import kept, shared_path

BLOCK = 1024
#: Rows (claim_id, doc_id, sent_ix) that are sent to all tasks, about 60 bytes each.
SENT_ROWS = 400_000
#: Levels of several blocks that are sent to all tasks, about 40 bytes each.
SENT_LEVELS = 500_000
#: Levels in which a part of 1 is cut.
STEPS = 4
#: Postings of a query that are read for the threshold, for each result wanted.
SEEDS = 100
#: Part of the threshold that may be left unread.
UNREAD = 0.5
#: Scores are rounded to R.DIGITS, so equal ones may differ by as much as this before.
SLACK = 2 * 10.0**-R.DIGITS


@dataclass
class Index:
    """blocks: term, level, shard, bound, postings [(doc_id, sent_ix)]; levels: term, level, bound, size, n_blocks; sentences: doc_id, sent_ix, sentence, terms, parts."""

    path: str
    blocks: DataFrame
    levels: DataFrame
    sentences: DataFrame


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(path, *(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "levels", "sentences")))


def build(docs: DataFrame, path: str | None = None) -> Index:
    """Index docs (doc_id, text) at path, by default in the shared folder.

    Null texts are empty; rows without doc_id are left out; rows of one doc_id
    are one document's. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "index")
    sents = R.sentences(docs.where("doc_id is not null"))
    terms = R.bm25_postings(sents).groupBy("doc_id", "sent_ix").agg(F.sort_array(F.collect_list(F.struct("term", "part"))).alias("x"))
    full = sents.join(terms, ["doc_id", "sent_ix"]).select("doc_id", "sent_ix", "sentence", F.col("x.term").alias("terms"), F.col("x.part").alias("parts"))
    full.write.parquet(f"{path}/sentences")
    # postings are never a table of their own: both steps take them from the sentences' arrays
    each = spark.read.parquet(f"{path}/sentences").select("doc_id", "sent_ix", F.explode(F.arrays_zip("terms", "parts")).alias("x"))
    postings = each.select("doc_id", "sent_ix", F.col("x.terms").alias("term"), F.col("x.parts").alias("part")).withColumn("level", F.floor(F.col("part") * STEPS).cast("int"))
    sizes = postings.groupBy("term", "level").agg(F.count("*").alias("size"), F.max("part").alias("bound"))
    sizes.withColumn("n_blocks", F.ceil(F.col("size") / BLOCK)).write.parquet(f"{path}/levels")
    # only levels of several blocks must be known to deal postings: one at most for each BLOCK of all postings
    large = spark.read.parquet(f"{path}/levels").where("n_blocks > 1").select("term", "level", "n_blocks")
    few = large.limit(SENT_LEVELS + 1).count() <= SENT_LEVELS
    dealt = postings.join(F.broadcast(large) if few else large, ["term", "level"], "left")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "sent_ix"), F.coalesce("n_blocks", F.lit(1).cast("long"))))
    blocks = dealt.groupBy("term", "level", "shard").agg(F.max("part").alias("bound"), F.collect_list(F.struct("doc_id", "sent_ix")).alias("postings"))
    blocks.write.parquet(f"{path}/blocks")
    return open_index(spark, path)


def _score(found: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """(claim_id, doc_id, sent_ix, score) of the distinct sentences found, from all terms of their sentences."""
    found = kept(found.distinct())
    few = found.limit(SENT_ROWS + 1).count() <= SENT_ROWS  # then the sentences need not be shuffled
    rows = index.sentences.select("doc_id", "sent_ix", "terms", "parts").join(F.broadcast(found) if few else found, ["doc_id", "sent_ix"]).join(queries, "claim_id")
    part = lambda t, p: F.coalesce(F.element_at("asked", t), F.lit(0)) * p
    total = F.aggregate(F.zip_with("terms", "parts", part), F.lit(0.0), lambda a, x: a + x)
    return rows.select("claim_id", "doc_id", "sent_ix", T.floor_to(total, R.DIGITS).alias("score")).where("score > 0")


def _documents(scores: DataFrame, n: int) -> DataFrame:
    """The n best documents of each claim, by their best sentence (of equal ones the last); ties to the smaller doc_id."""
    best = scores.groupBy("claim_id", "doc_id").agg(F.max(F.struct("score", "sent_ix")).alias("x")).select("claim_id", "doc_id", "x.sent_ix", "x.score")
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _read(index: Index, wanted: DataFrame, *also: str) -> DataFrame:
    """(claim_id, doc_id, sent_ix and also) of the postings in wanted blocks (claim_id, term, level and, for a single block, shard)."""
    keys = ["term", "level", *(["shard"] if "shard" in wanted.columns else [])]
    rows = wanted.join(index.blocks.select("term", "level", "shard", "postings"), keys)
    return rows.select("claim_id", *also, F.explode("postings").alias("x")).select("claim_id", *also, "x.doc_id", "x.sent_ix")


def plan(index: Index, claims: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(queries, wanted): the levels that a search reads, as claim_id, term, level, size, gain (what a posting adds to rest at most), rest, threshold."""
    terms = R.claim_terms(claims, R.split_words)
    queries = kept(terms.groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "qf"))).alias("asked")))
    claim, term = Window.partitionBy("claim_id"), Window.partitionBy("claim_id", "term")
    each = terms.join(index.levels.where("bound > 0"), "term").withColumn("most", F.col("qf") * F.col("bound"))
    each = kept(each.withColumn("often", F.sum("size").over(term)))
    before = F.sum(F.least("size", F.lit(BLOCK))).over(claim.orderBy("often", "term", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1))
    first = each.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SEEDS * n)
    seeds = first.select("claim_id", "term", "level", F.lit(0).cast("long").alias("shard"))
    reached = _documents(_score(_read(index, seeds), index, queries), n).groupBy("claim_id").agg(F.count("*").alias("found"), F.min("score").alias("low"))
    threshold = reached.select("claim_id", F.when(F.col("found") >= n, F.col("low") - SLACK).otherwise(0.0).alias("threshold"))
    up = term.orderBy("most", "level")
    steps = each.withColumn("step", F.col("most") - F.coalesce(F.lag("most").over(up), F.lit(0.0)))
    # the worth of leaving a level unread falls inside a term, so that lower levels come first
    steps = steps.withColumn("worth", F.min(F.col("size") / (F.col("step") + 1e-9)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("upto", F.sum("step").over(claim.orderBy(F.desc("worth"), "term", "most", "level").rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.join(threshold, "claim_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    unread = F.col("upto") <= UNREAD * F.col("threshold")
    steps = steps.withColumn("unread", unread).withColumn("base", F.coalesce(F.max(F.when(unread, F.col("most"))).over(term), F.lit(0.0)))
    steps = steps.withColumn("rest", F.coalesce(F.sum(F.when(unread, F.col("step"))).over(claim), F.lit(0.0)))
    wanted = steps.where(~F.col("unread")).select("claim_id", "term", "level", "size", (F.col("most") - F.col("base")).alias("gain"), "rest", "threshold")
    return queries, kept(wanted)


def candidates(index: Index, wanted: DataFrame) -> DataFrame:
    """(claim_id, doc_id, sent_ix) of the sentences whose bounds reach the threshold."""
    rows = _read(index, wanted, "gain", "rest", "threshold").groupBy("claim_id", "doc_id", "sent_ix", "rest", "threshold").agg(F.sum("gain").alias("gain"))
    return rows.where(F.col("rest") + F.col("gain") >= F.col("threshold")).select("claim_id", "doc_id", "sent_ix")


def search(index: Index, claims: DataFrame, n: int = 5) -> DataFrame:
    """(claim_id, doc_id, sent_ix, score, rank): the n documents with the best BM25 sentence for each claim (claim_id, claim), exactly.

    Claims that are null or empty, or share no word with the corpus, have no rows.
    """
    queries, wanted = plan(index, claims, n)
    return _documents(_score(candidates(index, wanted), index, queries), n)


def scan(claims: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame | None:
    """What search() finds, from docs (doc_id, text) without an index: texts are dealt once, the best of every batch once more. None for more claims than go to all tasks."""
    best = R.best_of_batches(claims, docs, n)
    if best is None:
        return None
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def best_documents(claims: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """(claim_id, doc_id, score, rank): documents by their best BM25 sentence, a search over the corpus.

    One search is no reason for an index, which takes many times the disk of the
    texts; only claims of too many words for a scan build one.
    """
    found = scan(claims, docs, n)
    if found is None:
        found = search(build(docs), claims, n)
    return found.select("claim_id", "doc_id", "score", "rank")
