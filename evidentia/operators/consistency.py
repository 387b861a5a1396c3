"""Agreement between an image and the text it comes with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as T

# Weights of the components, score by authenticity label.
WEIGHTS = (0.35, 0.20, 0.25, 0.20)
LABEL_SCORES = {"likely_ai_generated": 0.0, "possibly_ai_generated": 0.3, "possibly_manipulated": 0.3, "likely_manipulated": 0.1, "possibly_authentic": 0.85, "likely_authentic": 1.0, "inconclusive": 0.5}
# Texts of flags.
MISMATCH = "OCR_TEXT_MISMATCH: Image text shares very few keywords with submitted claim."
CONSISTENT = "OCR_TEXT_CONSISTENT: Image text strongly matches the submitted claim."
VIRAL = "VIRAL_RECIRCULATION: This image has been submitted multiple times — may be misused in different contexts."
DUPLICATE = "POSSIBLE_DUPLICATE: Image is visually similar to a previously analysed image."


def exif_year(original: Column, plain: Column, digitized: Column) -> Column:
    """Year of the first of the three EXIF dates that has one."""
    return F.coalesce(*[F.get(T.years(T.text(c)), F.lit(0)) for c in (original, plain, digitized)])


def consistency(ocr: Column, claims: Column, raw: Column, phash_verdict: Column, exif: Column, label: Column) -> Column:
    """struct(score, flags, ocr_overlap, year_diff). claims: array of texts; exif: year or null."""
    claims = F.coalesce(claims, F.array().cast("array<string>"))
    joined = F.array_join(claims, " ")
    ocr_t, raw_t = T.text(ocr), T.text(raw)
    by_claim, by_raw = (ocr_t != "") & (F.size(claims) > 0), (ocr_t != "") & (raw_t != "")
    overlap = F.when(by_claim, T.keyword_jaccard(ocr_t, joined)).when(by_raw, T.keyword_jaccard(ocr_t, raw_t))
    years = F.concat(F.flatten(F.transform(claims, T.years)), T.years(raw_t))
    diff = F.array_min(F.transform(years, lambda y: F.abs(y - exif)))
    date = F.when(diff.isNull(), 0.5).when(diff == 0, 1.0).when(diff <= 1, 0.7).when(diff <= 3, 0.4).otherwise(0.0)
    viral = F.when(phash_verdict == "VIRAL_RECIRCULATION", 0.1).when(phash_verdict == "POSSIBLE_DUPLICATE", 0.4).otherwise(0.8)
    known = F.create_map(*[F.lit(x) for kv in LABEL_SCORES.items() for x in kv])
    ai = F.when(T.text(label) == "", 0.5).otherwise(F.coalesce(known[F.lower(label)], F.lit(0.5)))
    parts = (F.coalesce(overlap, F.lit(0.5)), date, viral, ai)
    score = sum((p * w for p, w in zip(parts, WEIGHTS)), F.lit(0.0)) / sum(WEIGHTS)
    told = F.concat(F.lit(": EXIF year "), exif, F.lit(" differs from claim year(s) ["), F.array_join(F.transform(years, lambda y: y.cast("string")), ", "), F.lit("] by "), diff, F.lit(" years"))
    flags = F.array_compact(
        F.array(
            F.when(by_claim & (overlap < 0.05), MISMATCH).when(by_claim & (overlap > 0.4), CONSISTENT),
            F.when(diff.between(2, 3), F.concat(F.lit("DATE_MISMATCH"), told, F.lit("."))).when(diff > 3, F.concat(F.lit("DATE_MISMATCH_CRITICAL"), told, F.lit(" — old image reuse suspected."))),
            F.when(phash_verdict == "VIRAL_RECIRCULATION", VIRAL).when(phash_verdict == "POSSIBLE_DUPLICATE", DUPLICATE),
            F.when((T.text(label) != "") & (ai < 0.4), F.concat(F.lit("AI_GENERATED: Image scored as '"), label, F.lit("' — reduces overall consistency."))),
        )
    )
    return F.struct(T.floor_to(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("score"), flags.alias("flags"), T.floor_to(overlap, 4).alias("ocr_overlap"), diff.alias("year_diff"))
