"""Submissions of text, images or both, from claim to report, as one plan over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import urls as U
from evidentia.operators import claims as C
from evidentia.operators import entities as N
from evidentia.operators import evidence as E
from evidentia.operators import retrieval as R
from evidentia.operators import verdicts as V
from evidentia.plans.full_report import full_reports, rejected_sources
from evidentia.plans.multimodal import image_facts, image_only, texts_to_check, with_consistency
from evidentia.plans.schemas import stable_id
from evidentia.plans.storage import kept
from evidentia.sources.search import CorpusProvider, SearchProvider

HITS, SENTENCES = 3, 2


@dataclass
class Run:
    claims: DataFrame
    hits: DataFrame
    evidence: DataFrame
    verdicts: DataFrame
    reports: DataFrame
    rejected: DataFrame
    full_reports: DataFrame
    images: DataFrame | None = None


def run_pipeline(submissions: DataFrame, documents: DataFrame, provider: SearchProvider | None = None, hits_per_query: int = HITS, images: DataFrame | None = None, engines: dict | None = None) -> Run:
    """submissions (submission_id, text), documents (doc_id, text, url, title) -> the tables of a run.

    Claims that fail the gate search nothing; hits below the acceptance rule
    aren't read; sources that aren't relevant yield no evidence, but a row of
    rejected and a place in the full report; what has no text at all has
    neither claims nor a verdict. images (submission_id, height, width,
    nChannels, data, created_at): an image's text stands in for a missing one;
    an image without any text gets a verdict from its label alone. engines:
    readers of pictures, as variants.recognised takes them.
    """
    facts = None if images is None else image_facts(images, engines)
    if facts is not None:
        submissions = kept(texts_to_check(submissions, facts))
    subs = submissions.where(T.strip(T.text("text")) != "").select("submission_id", "text")
    claims = C.gate(C.extract(subs).select("submission_id", "claim_ix", "claim"))
    claims = claims.withColumn("claim_id", stable_id(F.col("submission_id"), F.col("claim_ix"))).withColumn("e", N.entities(F.col("claim")))
    claims = claims.withColumn("names", F.concat("e.orgs", "e.persons")).withColumn("places", F.col("e.locations")).withColumn("topics", F.col("e.concepts"))
    claims = C.with_queries(claims, names="names", locations="places", concepts="topics").drop("names", "places", "topics")
    claims = kept(claims)

    valid = claims.where("status = 'VALID'")
    routed = valid.select("claim_id", "claim", F.posexplode(C.routed_queries(C.usable_queries(F.col("queries")))).alias("q_ord", "query"))
    asked = routed.withColumn("query_id", stable_id(F.col("query")))
    # equal queries are asked once
    found = (provider or CorpusProvider(documents)).search(asked.select("query_id", "query").distinct(), hits_per_query)
    hits = kept(C.accept_hits(asked.drop("query").join(found.withColumnRenamed("rank", "hit_ord"), "query_id")))

    read = hits.select("claim_id", "claim", "rank", "url").join(documents.select("doc_id", "url", F.col("text").alias("document")), "url")
    read = read.withColumn("is_social", U.is_social(F.col("url"))).where(E.long_enough(F.col("document"), F.col("is_social")))
    orgs = valid.select("claim_id", "submission_id", F.col("e.orgs").alias("orgs"))
    judged = read.join(orgs, "claim_id").withColumn("relevance", E.relevance(F.col("claim"), F.col("document"), F.col("is_social"), F.col("orgs")))
    read = judged.where("relevance.relevant")

    pairs = read.select("claim_id", "doc_id", "url", "submission_id", "claim", "is_social", "rank")
    best = R.hybrid(valid.select("claim_id", "claim"), documents.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), SENTENCES)
    web = pairs.where(~F.col("is_social")).join(best.select("claim_id", "doc_id", F.col("sentence").alias("evidence_text"), F.col("combined").alias("ranked_score"), F.col("rank").alias("s_rank")), ["claim_id", "doc_id"])
    post = read.where("is_social").select("claim_id", "doc_id", "url", "submission_id", "claim", "is_social", "rank", F.col("document").alias("evidence_text"), F.lit(0.85).alias("ranked_score"), F.lit(1).alias("s_rank"))
    rows = E.evidence_rows(web.select(post.columns).unionByName(post))
    order = Window.partitionBy("submission_id").orderBy("claim_id", "rank", "doc_id", "s_rank")
    evidence = rows.select(
        "submission_id", "claim_id", F.col("doc_id").alias("document_id"), "url", "evidence_text", "support_score", "contradiction_score", "relevance_score", "retrieval_method", F.row_number().over(order).alias("seq"),
        F.col("relation.relationship").alias("relationship"), U.third_part(F.col("url")).alias("domain"), U.source_type(F.col("url")).alias("source_type"), F.when(F.col("is_social"), U.platform_label(U.platform(F.col("url")))).alias("platform_label"),
    )
    evidence = kept(evidence)
    place = Window.partitionBy("submission_id").orderBy("claim_id", "rank", "doc_id")
    after = F.lit(1 << 40) + F.row_number().over(place)
    rejected = kept(rejected_sources(judged.where("not relevance.relevant").withColumn("seq", after).withColumnRenamed("doc_id", "document_id")).select(evidence.columns))
    verdicts = V.overall_verdicts(subs, claims, hits, evidence)
    if facts is None:
        verdicts = verdicts.withColumn("image_verdict", F.lit(None).cast("string"))
    else:
        facts = kept(with_consistency(facts, submissions, claims))
        label = facts.select(F.col("submission_id").alias("key__"), "image_verdict")
        bare = image_only(submissions, facts).withColumns({c: F.lit(0).cast("long") for c in ("n_claims", "n_hits", "n_evidence")}).select(verdicts.columns)
        verdicts = verdicts.unionByName(bare).withColumn("key__", F.col("submission_id").cast("string")).join(label, "key__", "left").drop("key__")
    verdicts = kept(verdicts)
    reasons = kept(V.reasons(verdicts, evidence))
    reports = V.reports(verdicts, reasons, V.coverage(evidence))
    typed = None if facts is None else facts.withColumn("submission_id", F.col("submission_id").cast(verdicts.schema["submission_id"].dataType))
    full = full_reports(claims.select("submission_id", "claim_id", "claim", "status", "reject_reason", "queries"), evidence.unionByName(rejected), verdicts, reasons, typed)
    return Run(claims, hits, evidence, verdicts, reports, rejected, full, facts)
