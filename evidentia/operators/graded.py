"""Graded verdicts and weighted source quality: the rules that are planned, beside the ones in use.

Nothing else calls these; they answer the same questions as verdicts, images
and urls do, on finer scales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T

# Weights of the quality components.
QUALITY = {"authority": 0.30, "type": 0.20, "recency": 0.15, "directness": 0.20, "corroboration": 0.15}
# Score by source type.
TYPE_SCORES = {"government": 1.0, "fact_checker": 1.0, "news": 0.7, "web": 0.4, "social_media": 0.1, "unknown": 0.0}
HALF_LIFE_DAYS = 365.0


def claim_verdict(support: Column, contradiction: Column, independent: Column, pieces: Column, coverage: Column, other_context: Column | None = None) -> Column:
    """Seven grades; too little to go on decides first, then the first rule that fits."""
    s, c = F.coalesce(support, F.lit(0.0)), F.coalesce(contradiction, F.lit(0.0))
    differs = F.lit(False) if other_context is None else F.coalesce(other_context, F.lit(False))
    return (
        F.when((F.coalesce(pieces, F.lit(0)) < 2) | (F.coalesce(coverage, F.lit(0.0)) < 0.2), "INSUFFICIENT_EVIDENCE")
        .when((s >= 0.75) & (c < 0.2) & (independent >= 2) & ~differs, "SUPPORTED")
        .when((s >= 0.55) & (c < 0.3) & ~differs, "LIKELY_SUPPORTED")
        .when((s >= 0.35) & (c < 0.4) & ~differs, "PARTIALLY_SUPPORTED")
        .when((s >= 0.3) & differs, "MISLEADING_CONTEXT")
        .when((c >= 0.65) & (independent >= 2), "CONTRADICTED")
        .when(c >= 0.4, "UNSUPPORTED")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


def image_verdict(ai: Column, ela: Column, noise: Column, frequency: Column, copy_move: Column) -> Column:
    a, e, n, f, m = (F.coalesce(x, F.lit(0.0)) for x in (ai, ela, noise, frequency, copy_move))
    strong = sum(((x >= 0.6).cast("int") for x in (e, n, m)), F.lit(0))
    return (
        F.when(a >= 0.75, "LIKELY_AI_GENERATED")
        .when((a >= 0.55) & (f >= 0.6), "POSSIBLY_AI_GENERATED")
        .when((strong >= 2) | (e >= 0.75), "LIKELY_MANIPULATED")
        .when(strong == 1, "POSSIBLY_MANIPULATED")
        .when((a < 0.2) & (e < 0.2) & (n < 0.2), "LIKELY_AUTHENTIC")
        .when((a < 0.35) & (F.greatest(e, n, m) < 0.35), "POSSIBLY_AUTHENTIC")
        .otherwise("INCONCLUSIVE")
    )


def source_quality(authority: Column, source_type: Column, age_days: Column, directness: Column, corroboration: Column) -> Column:
    """struct of the five components, each 0 to 1, and their weighted sum as score; an unknown age counts as a half."""
    types = F.create_map(*[F.lit(x) for kv in TYPE_SCORES.items() for x in kv])
    recency = F.when(age_days.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / HALF_LIFE_DAYS))
    parts = dict(zip(QUALITY, (authority, F.coalesce(types[source_type], F.lit(0.0)), recency, directness, corroboration)))
    unit = {k: F.least(F.greatest(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for k, v in parts.items()}
    score = sum((unit[k] * w for k, w in QUALITY.items()), F.lit(0.0))
    return F.struct(*[T.floor_to(v, 4).alias(k) for k, v in unit.items()], T.floor_to(score, 4).alias("score"))


def independent_sources(evidence: DataFrame) -> DataFrame:
    """evidence (submission_id, domain, evidence_text) -> independent and duplicate groups per submission.

    Sources that carry the same words are one origin, however many domains repeat it.
    """
    words = F.sha2(F.array_join(T.tokens(T.text("evidence_text")), " "), 256)
    groups = evidence.groupBy("submission_id", words.alias("origin")).agg(F.count_distinct("domain").alias("domains"))
    return groups.groupBy("submission_id").agg(F.count("*").alias("independent_source_count"), F.count_if(F.col("domains") > 1).alias("duplicate_source_group_count"))
