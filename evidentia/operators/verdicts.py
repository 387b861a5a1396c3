"""Verdicts, coverage, reasons, evidence graph and report: aggregations over evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reason sentences by verdict.
REASONS = {
    "SUPPORTED": "This news is REAL. Direct reports from reliable sources corroborate the claim.",
    "CONTRADICTED": "This news is FAKE. Credible sources and fact-checkers explicitly contradict the claim.",
    "LIKELY_MISLEADING": "This news is MISLEADING. Elements of truth exist, but critical context has been altered or misrepresented.",
    "OTHER": "The claim remains UNVERIFIED due to a lack of decisive public records or evidence.",
    "LIKELY_AI_GENERATED": "Additionally, image forensics detected significant synthetic/AI-generation artifacts.",
    "POSSIBLY_MANIPULATED": "Additionally, image forensics identified signs of digital editing or manipulation.",
}
LIMITATION = "Analysis reflects public web search, fact-check, and social media records indexed at verification time."
SURE, UNSURE, REFUTED = 0.88, 0.55, 0.90


def claim_verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(submission_id, claim_id, verdict): support beats contradiction; claims without evidence are UNVERIFIED."""
    flags = evidence.groupBy("claim_id").agg(F.bool_or(F.col("relationship") == "SUPPORTS").alias("s"), F.bool_or(F.col("relationship") == "CONTRADICTS").alias("c"))
    verdict = F.when(F.col("s"), "SUPPORTED").when(F.col("c"), "CONTRADICTED").otherwise("UNVERIFIED")
    return claims.select("submission_id", "claim_id").join(flags, "claim_id", "left").select("submission_id", "claim_id", verdict.alias("verdict"))


def verdict(n_claims: Column, n_hits: Column, supports: Column, contradicts: Column, n_evidence: Column) -> Column:
    s, c = F.coalesce(supports, F.lit(False)), F.coalesce(contradicts, F.lit(False))
    return (
        F.when(F.coalesce(n_claims, F.lit(0)) == 0, "INSUFFICIENT_EVIDENCE")
        .when(F.coalesce(n_hits, F.lit(0)) == 0, "UNVERIFIED")
        .when(s & ~c, "SUPPORTED")
        .when(c & ~s, "CONTRADICTED")
        .when(s & c, "LIKELY_MISLEADING")
        .when(F.coalesce(n_evidence, F.lit(0)) > 0, "INSUFFICIENT_EVIDENCE")
        .otherwise("UNVERIFIED")
    )


def verdict_confidence(v: Column) -> Column:
    return F.when(v.isin("SUPPORTED", "CONTRADICTED"), SURE).otherwise(UNSURE)


def overall_verdicts(submissions: DataFrame, claims: DataFrame, hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(submission_id, n_claims, n_hits, n_evidence, overall_status, confidence), one row per submission."""
    owner = claims.select("claim_id", "submission_id")
    c = claims.groupBy("submission_id").agg(F.count("*").alias("n_claims"))
    h = hits.select("claim_id").join(owner, "claim_id").groupBy("submission_id").agg(F.count("*").alias("n_hits"))
    e = (
        evidence.select("claim_id", "relationship")
        .join(owner, "claim_id")
        .groupBy("submission_id")
        .agg(F.count("*").alias("n_evidence"), F.bool_or(F.col("relationship") == "SUPPORTS").alias("s"), F.bool_or(F.col("relationship") == "CONTRADICTS").alias("c"))
    )
    rows = submissions.select("submission_id").join(c, "submission_id", "left").join(h, "submission_id", "left").join(e, "submission_id", "left")
    overall = verdict(F.col("n_claims"), F.col("n_hits"), F.col("s"), F.col("c"), F.col("n_evidence"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return rows.select("submission_id", zero("n_claims"), zero("n_hits"), zero("n_evidence"), overall.alias("overall_status")).withColumn("confidence", verdict_confidence(F.col("overall_status")))


def coverage(evidence: DataFrame) -> DataFrame:
    """Per submission: distinct web sources, social rows, pieces for or against, distinct sources.

    Of several rows of a URL the last (seq) decides its source type. evidence:
    submission_id, seq, url, source_type, relationship.
    """
    last = evidence.groupBy("submission_id", "url").agg(F.max_by("source_type", "seq").alias("t"))
    web = last.groupBy("submission_id").agg(F.count_if(F.col("t") != "social_media").alias("web_sources_checked"), F.count("url").alias("independent_source_count"))
    rows = evidence.groupBy("submission_id").agg(F.count_if(F.col("source_type") == "social_media").alias("social_sources_checked"), F.count_if(F.col("relationship").isin("SUPPORTS", "CONTRADICTS")).alias("total_evidence_pieces"))
    return rows.join(web, "submission_id")


def _names(c: Column) -> Column:
    return F.array_join(F.slice(F.sort_array(F.collect_set(c)), 1, 3), ", ")


def reasons(verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(submission_id, reason): the verdict's sentence, up to three domains, the image's and the platforms' sentence.

    verdicts: submission_id, overall_status, image_verdict. evidence:
    submission_id, domain, relationship, platform_label (null off social media).
    """
    sets = evidence.groupBy("submission_id").agg(
        _names(F.when(F.col("relationship") == "SUPPORTS", F.col("domain"))).alias("pro"),
        _names(F.when(F.col("relationship") == "CONTRADICTS", F.col("domain"))).alias("con"),
        F.array_join(F.sort_array(F.collect_set("platform_label")), ", ").alias("social"),
    )
    out = reason(F.col("overall_status"), F.col("image_verdict"), F.col("pro"), F.col("con"), F.col("social"))
    return verdicts.join(sets, "submission_id", "left").select("submission_id", out.alias("reason"))


def reason(v: Column, image_verdict: Column, pro: Column, con: Column, social: Column) -> Column:
    """The sentences of a verdict; pro, con and social are joined names, empty or null for none."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    base = F.when(v == "SUPPORTED", REASONS["SUPPORTED"]).when(v.isin("CONTRADICTED", "LIKELY_FALSE"), REASONS["CONTRADICTED"]).when(v == "LIKELY_MISLEADING", REASONS["LIKELY_MISLEADING"]).otherwise(REASONS["OTHER"])
    parts = [
        base,
        F.when((v == "SUPPORTED") & some(pro), F.concat(F.lit("Supporting articles were verified on domains including "), pro, F.lit("."))),
        F.when(v.isin("CONTRADICTED", "LIKELY_FALSE") & some(con), F.concat(F.lit("Contradictory findings were published on "), con, F.lit("."))),
        F.when(image_verdict == "LIKELY_AI_GENERATED", REASONS["LIKELY_AI_GENERATED"]).when(image_verdict == "POSSIBLY_MANIPULATED", REASONS["POSSIBLY_MANIPULATED"]),
        F.when(some(social), F.concat(F.lit("Social media activity was also tracked on "), social, F.lit(" with active public discussion."))),
    ]
    return F.concat_ws(" ", *parts)


def edges(evidence: DataFrame) -> DataFrame:
    """Claim-to-document edges with relation and weight from the two scores; other columns stay."""
    kind = F.when(F.col("support_score") > 0.5, "SUPPORTS").when(F.col("contradiction_score") > 0.5, "CONTRADICTS").otherwise("CONTEXT")
    weight = F.when(F.col("support_score") > 0.5, 0.7).when(F.col("contradiction_score") > 0.5, 0.9).otherwise(0.4)
    return evidence.select(
        "submission_id", F.lit("claim").alias("from_node_type"), F.col("claim_id").cast("string").alias("from_node_id"), F.lit("document").alias("to_node_type"), F.col("document_id").cast("string").alias("to_node_id"),
        kind.alias("relationship_type"), weight.alias("weight"),
    )


def nodes(graph: DataFrame) -> DataFrame:
    """(submission_id, node_key, node_type, label): the distinct endpoints of edges."""
    ends = [graph.select("submission_id", F.col(f"{x}_node_type").alias("node_type"), F.col(f"{x}_node_id").alias("node_id")) for x in ("from", "to")]
    both = ends[0].unionByName(ends[1]).distinct()
    return both.select("submission_id", F.concat_ws(":", "node_type", "node_id").alias("node_key"), "node_type", F.concat_ws("/", "node_type", F.substring("node_id", 1, 8)).alias("label"))


def numbered_evidence(evidence: DataFrame) -> DataFrame:
    """Report rows of supporting and contradicting evidence, each side numbered ev-1, ev-2, ... by seq."""
    order = Window.partitionBy("submission_id", "relationship").orderBy("seq")
    rows = evidence.where(F.col("relationship").isin("SUPPORTS", "CONTRADICTS"))
    pro = F.col("relationship") == "SUPPORTS"
    return rows.select(
        "submission_id", "relationship", F.concat(F.lit("ev-"), F.row_number().over(order)).alias("ev_id"), "claim_id", "evidence_text",
        F.when(pro, SURE).otherwise(0.0).alias("support_score"), F.when(pro, 0.0).otherwise(REFUTED).alias("contradiction_score"),
    )


def last_sources(evidence: DataFrame) -> DataFrame:
    """One row per submission and URL: values of its last row, position of its first."""
    order = Window.partitionBy("submission_id").orderBy("first_seq")
    rows = evidence.groupBy("submission_id", "url").agg(F.max_by("source_type", "seq").alias("source_type"), F.max_by("relationship", "seq").alias("relationship"), F.min("seq").alias("first_seq"))
    return rows.withColumn("position", F.row_number().over(order)).drop("first_seq")


def reports(verdicts: DataFrame, reason: DataFrame, cover: DataFrame) -> DataFrame:
    """(submission_id, report): the stored JSON; null fields are left out."""
    rows = verdicts.join(reason, "submission_id").join(cover, "submission_id", "left")
    body = F.struct(
        "submission_id", "overall_status", F.col("overall_status").alias("claim_verdict"), F.col("confidence").alias("claim_confidence"), "image_verdict", F.col("reason").alias("summary"),
        F.struct("web_sources_checked", "social_sources_checked", "total_evidence_pieces").alias("search_coverage"), "independent_source_count", F.array(F.lit(LIMITATION)).alias("limitations"),
    )
    return rows.select("submission_id", F.to_json(F.struct(body.alias("full_report"))).alias("report"))


def image_only_verdict(label: Column, score: Column) -> Column:
    """Verdict of an image without any text."""
    return F.struct(F.lit("NO_TEXT_FOUND").alias("claim_verdict"), F.coalesce(F.upper(label), F.lit("UNKNOWN")).alias("overall_status"), F.coalesce(score, F.lit(0.75)).alias("confidence"))


def evaluation(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row of binary metrics; a rate without cases is null."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return n.select(
        "tp", "fp", "fn", "tn", rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"),
    )
