"""The whole report of a submission, put together from the tables of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import urls as U
from evidentia.operators import verdicts as V
from evidentia.plans.schemas import stable_id

REJECTED = "REJECTED"
# What a report shows of images where a submission has none, and of a claim that failed the gate.
NO_IMAGE_TYPE, NO_ENGINE, GATE = "general", "PaddleOCR", "Failed quality gate"
IMAGE = (
    "submission_id string, image_type string, image_verdict string, image_confidence double, ocr_text string, ocr_engine string, ocr_confidence double, ela double, noise double, frequency double, copy_move double, "
    "match_verdict string, prior_sightings_count long, consistency double, flags array<string>"
)
#: What a report takes of a row of evidence, which is ordered by seq, and of a claim; its lists.
EVIDENCE = ["seq", "claim_id", "url", "domain", "source_type", "relevance_score", "relationship", "platform_label", "evidence_text"]
LISTS = ["claims", "supporting_evidence", "contradicting_evidence", "sources", "social_media_evidence"]
CLAIM = ["submission_id", "claim_id", "claim", "status", "reject_reason", "queries"]


def rejected_sources(judged: DataFrame) -> DataFrame:
    """judged (submission_id, claim_id, document_id, url, seq, relevance) -> evidence rows REJECTED, with the reason as text, of sources that aren't relevant."""
    out = judged.where(~F.col("relevance.relevant"))
    zero = F.lit(0.0)
    return out.select(
        "submission_id", "claim_id", "document_id", "url", F.concat(F.lit(f"{REJECTED}: "), F.col("relevance.reason")).alias("evidence_text"), zero.alias("support_score"), zero.alias("contradiction_score"),
        zero.alias("relevance_score"), F.lit("none").alias("retrieval_method"), "seq", F.lit(REJECTED).alias("relationship"), U.third_part(F.col("url")).alias("domain"), U.source_type(F.col("url")).alias("source_type"),
        F.lit(None).cast("string").alias("platform_label"),
    )


def _in_order(c: Column) -> Column:
    """The v of an array of (o, v), by o."""
    return F.transform(F.array_sort(c), lambda x: x["v"])


def _source(e: Column) -> Column:
    kind, url = e["source_type"], e["url"]
    return F.struct(
        stable_id(url).alias("id"), e["domain"].alias("title"), url.alias("url"), e["domain"].alias("domain"), kind.alias("source_type"), U.authority(kind).alias("authority_score"), U.authority(kind).alias("quality_score"),
        e["relevance_score"].alias("relevance_score"), (e["relationship"] == "SUPPORTS").alias("supports_claim"), (e["relationship"] == "CONTRADICTS").alias("contradicts_claim"), F.substring(e["evidence_text"], 1, 350).alias("evidence"),
    )


def _claim(c: Column, sources: Column) -> Column:
    any_source = lambda field: F.exists(sources, lambda s: s[field])
    valid = F.coalesce(c["status"], F.lit("VALID")) != "INVALID_CLAIM"
    shown = lambda x: F.when(valid, x)
    return F.struct(
        shown(c["claim_id"].cast("string")).alias("id"), shown(c["submission_id"].cast("string")).alias("submission_id"), c["claim"].alias("claim_text"), F.when(~valid, c["status"]).alias("status"),
        F.when(~valid, F.coalesce(c["reject_reason"], F.lit(GATE))).alias("reason"), shown(F.lit(0.6)).alias("claim_confidence"), shown(c["queries"]).alias("search_queries_json"), shown(sources).alias("sources"),
        shown(F.when(any_source("supports_claim"), "SUPPORTED").when(any_source("contradicts_claim"), "CONTRADICTED").otherwise("UNVERIFIED")).alias("verdict"),
    )


def _pieces(evidence: Column, kind: str) -> Column:
    pro = kind == "SUPPORTS"
    support, against = (V.SURE, 0.0) if pro else (0.0, V.REFUTED)
    piece = lambda e, i: F.struct(
        F.concat(F.lit("ev-"), i + 1).alias("id"), e["claim_id"].cast("string").alias("claim_id"), F.lit("").alias("document_id"), e["evidence_text"].alias("evidence_text"), F.lit(support).alias("support_score"),
        F.lit(against).alias("contradiction_score"), F.lit("multi_source_search").alias("retrieval_method"), F.lit("").alias("created_at"),
    )
    return F.transform(F.filter(evidence, lambda e: e["relationship"] == kind), piece)


def _lists(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(submission_id, and the lists of its report); a submission's claims, hits and sentences are bounded by its run.

    Evidence and claims are dealt by submission once; every list is taken from
    the rows that then stand together.
    """
    rows = evidence.select("submission_id", "claim_id", F.struct(*EVIDENCE).alias("e")).unionByName(claims.select("submission_id", "claim_id", F.struct(*CLAIM).alias("c")), allowMissingColumns=True)
    return _gathered(rows.repartition("submission_id"))


def _gathered(rows: DataFrame, *counted: str) -> DataFrame:
    """_lists of rows (submission_id, claim_id, e and c: structs or null) that lie with their submission; of the columns counted, how many aren't null."""
    sums = [F.sum(c).alias(c) for c in counted]
    own = rows.groupBy("submission_id", "claim_id").agg(F.collect_list("c").alias("cs"), F.array_sort(F.collect_list("e")).alias("es"), *[F.count(c).alias(c) for c in counted])
    none = F.array().cast(own.schema["es"].dataType)
    all_rows = own.groupBy("submission_id").agg(F.collect_list(F.struct("claim_id", "cs", F.when(F.col("claim_id").isNull(), none).otherwise(F.col("es")).alias("es"))).alias("by_claim"), F.array_sort(F.flatten(F.collect_list("es"))).alias("evidence"), *sums)
    by_url = F.array_sort(F.transform("evidence", lambda x: F.struct(x["url"].alias("url"), x["seq"].alias("seq"), x.alias("e"))))
    all_rows = all_rows.select("*", by_url.alias("by_url"))
    same = lambda x, i: F.get("by_url", i)["url"].eqNullSafe(x["url"])
    first = F.filter("by_url", lambda x, i: (i == 0) | ~same(x, i - 1))
    last = F.filter("by_url", lambda x, i: (i == F.size("by_url") - 1) | ~same(x, i + 1))
    listed = lambda g: F.transform(g["cs"], lambda c: F.struct(g["claim_id"].alias("o"), _claim(c, F.transform(g["es"], _source)).alias("v")))
    post = lambda x: F.struct(U.platform(x["url"]).alias("platform"), x["platform_label"].alias("platform_label"), F.substring(x["evidence_text"], 1, 350).alias("post_text"), x["url"].alias("url"), x["relationship"].alias("relevance"))
    return all_rows.select(
        "submission_id", _in_order(F.flatten(F.transform("by_claim", listed))).alias("claims"), _pieces(F.col("evidence"), "SUPPORTS").alias("supporting_evidence"), _pieces(F.col("evidence"), "CONTRADICTS").alias("contradicting_evidence"),
        _in_order(F.zip_with(first, last, lambda f, x: F.struct(f["seq"].alias("o"), _source(x["e"]).alias("v")))).alias("sources"),
        F.transform(F.filter("evidence", lambda x: x["platform_label"].isNotNull()), post).alias("social_media_evidence"),
        *(["evidence", *counted] if counted else []),
    )


def full_reports(claims: DataFrame, evidence: DataFrame, verdicts: DataFrame, reasons: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(submission_id, report): the whole report as JSON, a row for each row of verdicts; null fields are left out.

    claims: submission_id, claim_id, claim, status, reject_reason, queries.
    evidence: rows of a run, rejected sources among them, ordered by seq.
    verdicts: submission_id, overall_status, confidence, image_verdict.
    images: one row for each submission with an image, as IMAGE.
    """
    found = _lists(claims, evidence)
    out = verdicts.join(reasons, "submission_id").join(found, "submission_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in LISTS})
    return _told(out, images)


def reports_in_place(rows: DataFrame, image_verdict: Column) -> DataFrame:
    """full_reports from rows that lie with their submission, which also give its verdict and reason; nothing is dealt again.

    rows: submission_id, claim_id, e (EVIDENCE as a struct), c (CLAIM as a struct),
    hit and submitted: not null where a row is one. A row for each submission
    that was submitted.
    """
    found = _gathered(rows.where("submission_id is not null"), "c", "hit", "submitted").where("submitted > 0")
    of = lambda kind: F.filter("evidence", lambda e: e["relationship"] == kind)
    names = lambda es, field: F.array_sort(F.array_distinct(F.array_compact(F.transform(es, lambda e: e[field]))))
    three = lambda kind: F.array_join(F.slice(names(of(kind), "domain"), 1, 3), ", ")
    overall = V.verdict(F.col("c"), F.col("hit"), F.size(of("SUPPORTS")) > 0, F.size(of("CONTRADICTS")) > 0, F.size("evidence"))
    out = found.withColumns({"overall_status": overall, "image_verdict": image_verdict}).withColumn("confidence", V.verdict_confidence(F.col("overall_status")))
    out = out.withColumn("reason", V.reason(F.col("overall_status"), F.col("image_verdict"), three("SUPPORTS"), three("CONTRADICTS"), F.array_join(names(F.col("evidence"), "platform_label"), ", ")))
    return _told(out)


def _told(out: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(submission_id, report) of rows with verdict, reason and lists."""
    fields = [c.split()[0] for c in IMAGE.split(", ") if c.split()[0] not in ("submission_id", "image_verdict")]
    if images is None:
        out = out.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in IMAGE.split(", ") if c.split()[0] in fields])
    else:
        out = out.join(images.select("submission_id", *fields), "submission_id", "left")
    n = lambda c: F.size(c)
    web = F.size(F.filter("sources", lambda s: s["source_type"] != "social_media"))
    cover = F.struct(web.alias("web_sources_checked"), n("social_media_evidence").alias("social_sources_checked"), (n("supporting_evidence") + n("contradicting_evidence")).alias("total_evidence_pieces"))
    engine, sure = F.coalesce("ocr_engine", F.lit(NO_ENGINE)), F.coalesce("ocr_confidence", F.lit(0.0))
    text = F.coalesce("ocr_text", F.lit(""))
    seen = F.when(F.col("match_verdict").isNotNull(), F.struct("match_verdict", "prior_sightings_count"))
    body = F.struct(
        "submission_id", "overall_status", F.col("overall_status").alias("claim_verdict"), F.col("confidence").alias("claim_confidence"), "image_verdict", "image_confidence", F.col("reason").alias("summary"), *LISTS,
        cover.alias("search_coverage"), F.coalesce("image_type", F.lit(NO_IMAGE_TYPE)).alias("image_type_detected"), engine.alias("ocr_engine_used"), sure.alias("ocr_confidence"), n("sources").alias("independent_source_count"),
        F.array().cast("array<string>").alias("timeline"), F.array(F.lit(V.LIMITATION)).alias("limitations"), F.struct(engine.alias("engine_used"), text.alias("raw_text"), text.alias("cleaned_text"), sure.alias("overall_confidence")).alias("ocr"),
        F.struct(F.col("image_confidence").alias("ai_likelihood_score"), F.coalesce("image_verdict", F.lit("UNKNOWN")).alias("ai_likelihood_label"), F.col("ela").alias("ela_score"), F.col("noise").alias("noise_anomaly"), F.col("frequency").alias("frequency_anomaly"), F.col("copy_move").alias("copy_move_score"), seen.alias("phash_match")).alias("forensics"),
        F.struct(F.col("consistency").alias("score"), "flags").alias("multimodal_consistency"),
        F.struct(F.col("overall_status").alias("claim_verdict"), "image_verdict", "overall_status", "confidence", "reason").alias("final"),
    )
    return out.select("submission_id", F.to_json(F.struct(body.alias("full_report"))).alias("report"))
