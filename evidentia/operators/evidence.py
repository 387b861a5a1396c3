"""Relevance of sources and the relation of evidence to claims, by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T

# Keywords, in order of precedence; they count inside words, too.
CONTRADICTION = [
    "false", "fake", "deny", "denies", "denied", "debunk", "debunked", "hoax", "fabricated", "doctored", "morphed", "misleading", "fact check",
    "no such", "untrue", "busted", "misinformation", "disinformation", "refuted", "baseless", "incorrect", "distortion", "claims falsely",
    "not true", "never said", "clarified that no", "distorted",
]
SUPPORT = [
    "confirmed", "announced", "approved", "passed", "issued", "held", "inaugurated", "declared", "verified", "signed", "stated", "enacted",
    "agreed", "launched", "according to official records", "data shows",
]
ATTRIBUTION = ["claimed", "alleged", "accused", "argued", "said", "posted", "tweeted", "shared", "captioned", "circulating", "viral video shows", "purportedly"]
VIRAL = ["viral", "post", "video"]
# Reasons given in results.
REASONS = {
    "empty": "Empty claim or document.",
    "short": "Social media post is too short to evaluate.",
    "social": "Social media post matches core claim subject.",
    "overlap": "Source has insufficient keyword overlap with the claim.",
    "fit": "Source matches claim entities and topics.",
    "none": "No text provided.",
    "irrelevant": "The text does not directly address the specifics of the claim.",
    "viral": "This social media post actively circulates or comments on the claim without authoritative verification.",
    "talk": "Social media commentary related to this topic.",
    "attributed": "The source reports that an entity made this allegation, but does not independently establish it as fact.",
    "support": "The source explicitly reports verified facts and events that align directly with the claim.",
    "context": "The source provides related background context without directly confirming or refuting the claim.",
}


def _result(relevant: bool, score: Column | float, reason: Column | str) -> Column:
    as_col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(relevant).alias("relevant"), as_col(score, "double").alias("score"), as_col(reason, "string").alias("reason"))


def relevance(claim: Column, document: Column, is_social: Column, orgs: Column | None = None) -> Column:
    """struct(relevant, score, reason) of a source for a claim.

    A social post that is long enough but shares nothing is judged as an
    article. orgs: names in the claim; a source that has none of several is out.
    """
    parts = F.struct(T.text(claim).alias("c"), T.text(document).alias("d"), F.lower(T.text(document)).alias("low"), T.key_words(T.text(claim)).alias("own"), F.array_distinct(T.tokens(T.text(document))).alias("there"))
    none = F.array().cast("array<string>")
    return T.let(F.struct(parts.alias("p"), F.coalesce(is_social, F.lit(False)).alias("s"), F.coalesce(orgs if orgs is not None else none, none).alias("o")), _relevance)


def _relevance(v: Column) -> Column:
    c, d, low, own, is_social, orgs = v["p"]["c"], v["p"]["d"], v["p"]["low"], v["p"]["own"], v["s"], v["o"]
    inside = F.size(F.filter(own, lambda w: F.contains(low, w)))
    distinct = F.array_distinct(own)
    overlap = F.size(F.array_intersect(distinct, v["p"]["there"]))
    ratio = F.when(F.size(distinct) > 0, overlap / F.size(distinct)).otherwise(1.0)
    long = lambda o: F.filter(T.words(F.lower(o)), lambda w: F.length(w) > 3)
    missing = F.filter(orgs, lambda o: (F.size(long(o)) > 0) & ~F.exists(long(o), lambda w: F.contains(low, w)))
    return (
        F.when((c == "") | (d == ""), _result(False, 0.0, REASONS["empty"]))
        .when(is_social & (F.length(T.strip(d)) < 20), _result(False, 0.1, REASONS["short"]))
        .when(is_social & ((inside >= 1) | (F.size(own) <= 2)), _result(True, 0.75, REASONS["social"]))
        .when((F.size(orgs) > 1) & (F.size(missing) == F.size(orgs)), _result(False, 0.0, F.concat(F.lit("Source is missing key organizations: "), F.array_join(missing, ", "))))
        .when((ratio < 0.18) & (overlap < 2), _result(False, ratio, REASONS["overlap"]))
        .otherwise(_result(True, F.least(ratio + 0.3, F.lit(1.0)), REASONS["fit"]))
    )


def _relation(name: str, alleged: Column | bool, confidence: float, reason: Column | str) -> Column:
    alleged = alleged if isinstance(alleged, Column) else F.lit(alleged)
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(name).alias("relationship"), alleged.alias("is_allegation"), F.lit(confidence).alias("confidence"), reason.alias("reason"))


def classify(claim: Column, evidence: Column, is_social: Column) -> Column:
    """struct(relationship, is_allegation, confidence, reason); the first rule that fits decides."""
    c, e = T.text(claim), T.text(evidence)
    return T.let(F.struct(c.alias("c"), e.alias("e"), F.lower(e).alias("low"), F.array_distinct(T.tokens(e)).alias("there"), T.key_words(c).alias("own"), F.coalesce(is_social, F.lit(False)).alias("s")), _signs)


def _signs(v: Column) -> Column:
    signs = [T.contains_any(v["low"], k).alias(n) for n, k in (("alleged", ATTRIBUTION), ("against", CONTRADICTION), ("support", SUPPORT))]
    overlap = F.size(F.filter(v["own"], lambda w: F.array_contains(v["there"], w)))
    return T.let(F.struct(v.alias("v"), overlap.alias("overlap"), *signs), _relation_of)


def _relation_of(x: Column) -> Column:
    c, e, low, is_social, overlap = x["v"]["c"], x["v"]["e"], x["v"]["low"], x["v"]["s"], x["overlap"]
    alleged, against, support = x["alleged"], x["against"], x["support"]
    digits = lambda x: F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
    same_number = F.arrays_overlap(digits(c), digits(e))
    rupees = F.contains(c, F.lit("₹")) & F.contains(e, F.lit("₹"))
    refuted = F.concat(F.lit("The source explicitly refutes the claim using terms such as '"), F.array_join(T.first_contained(low, CONTRADICTION, 2), ", "), F.lit("'."))
    return (
        F.when((c == "") | (e == ""), _relation("IRRELEVANT", False, 0.0, REASONS["none"]))
        .when((overlap < 1) & ~is_social, _relation("IRRELEVANT", False, 0.85, REASONS["irrelevant"]))
        .when(against, _relation("CONTRADICTS", alleged, 0.90, refuted))
        .when(is_social & (alleged | T.contains_any(low, VIRAL)), _relation("SOCIAL_VIRAL_POST", True, 0.80, REASONS["viral"]))
        .when(is_social, _relation("CONTEXT", False, 0.65, REASONS["talk"]))
        .when(alleged & ~support, _relation("ATTRIBUTED_CLAIM", True, 0.82, REASONS["attributed"]))
        .when(support | (overlap >= 3) | same_number | rupees, _relation("SUPPORTS", False, 0.88, REASONS["support"]))
        .otherwise(_relation("CONTEXT", alleged, 0.60, REASONS["context"]))
    )


def long_enough(text: Column, is_social: Column) -> Column:
    return F.length(T.strip(T.text(text))) >= F.when(is_social, 20).otherwise(50)


def evidence_rows(rows: DataFrame) -> DataFrame:
    """rows (claim, evidence_text, is_social, ranked_score, ...) -> adds relation, scores and method."""
    out = rows.withColumn("relation", classify(F.col("claim"), F.col("evidence_text"), F.col("is_social")))
    kind, sure = F.col("relation.relationship"), F.col("relation.confidence")
    return (
        out.withColumn("support_score", F.when(kind == "SUPPORTS", sure).otherwise(0.0))
        .withColumn("contradiction_score", F.when(kind == "CONTRADICTS", sure).otherwise(0.0))
        .withColumn("relevance_score", F.when(F.col("is_social"), 0.85).otherwise(F.col("ranked_score")))
        .withColumn("retrieval_method", F.when(F.col("is_social"), "social_media_search").otherwise("bm25+tfidf"))
        .withColumn("evidence_text", F.substring("evidence_text", 1, 500))
    )
