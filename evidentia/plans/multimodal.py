"""Images of submissions: what is read, measured and seen before, and how it agrees with the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import consistency as K
from evidentia.operators import images as I
from evidentia.operators import metadata as M
from evidentia.operators import ocr as O
from evidentia.operators import variants
from evidentia.operators import verdicts as V
from evidentia.plans.storage import kept


def image_facts(images: DataFrame, engines: dict[str, Callable] | None = None) -> DataFrame:
    """images (submission_id, height, width, nChannels, data, created_at) -> a row for each with type, scores, label, matches and recognised text.

    Without engines, or where none reads anything, ocr_text is null. Pictures
    without pixels are UNREADABLE and match nothing.
    """
    rows = images.select(F.col("submission_id").cast("string").alias("id"), "height", "width", "nChannels", "data", "created_at")
    scores = I.forensic_scores(rows)
    r = I.ai_likelihood(F.col("ela"), F.col("noise"), F.col("frequency"), F.col("copy_move"))
    scores = scores.withColumn("r", r).select("id", "image_type", "ela", "noise", "frequency", "copy_move", F.col("r.label").alias("image_verdict"), F.col("r.score").alias("image_confidence"))
    hashed = kept(M.pixel_hashes(rows).join(rows.select("id", "created_at"), "id").select("id", "phash", "created_at"))
    seen = I.phash_verdicts(hashed, I.phash_matches(hashed)).select("id", "match_verdict", "prior_sightings_count")
    out = scores.join(seen, "id", "left")
    if engines:
        read = O.consensus(O.regions(variants.recognised(rows, engines)))
        out = out.join(read.select(F.col("image_id").alias("id"), F.col("text").alias("ocr_text"), F.col("engine_used").alias("ocr_engine"), F.col("overall_confidence").alias("ocr_confidence")), "id", "left")
    else:
        out = out.select("*", F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast("string").alias("ocr_engine"), F.lit(None).cast("double").alias("ocr_confidence"))
    return kept(out.withColumnRenamed("id", "submission_id"))


def texts_to_check(submissions: DataFrame, facts: DataFrame) -> DataFrame:
    """submissions (submission_id, text) with the text that claims come from: its own, else what its image says; input_type."""
    rows = submissions.withColumn("key__", F.col("submission_id").cast("string")).join(facts.select(F.col("submission_id").alias("key__"), "ocr_text", F.lit(True).alias("has_image")), "key__", "left")
    kind = I.input_type(F.col("text"), F.col("has_image"))
    own = T.strip(T.text("text")) != ""
    return rows.withColumn("input_type", kind).withColumn("raw_text", F.col("text")).withColumn("text", F.when(own, F.col("text")).otherwise(F.col("ocr_text"))).drop("key__", "ocr_text", "has_image")


def with_consistency(facts: DataFrame, submissions: DataFrame, claims: DataFrame) -> DataFrame:
    """facts with consistency and flags of submissions that have claims; a picture's year is not known here."""
    told = claims.groupBy(F.col("submission_id").cast("string").alias("submission_id")).agg(F.sort_array(F.collect_list("claim")).alias("claim_texts"))
    raw = submissions.select(F.col("submission_id").cast("string").alias("submission_id"), "raw_text")
    rows = facts.join(told, "submission_id", "left").join(raw, "submission_id", "left")
    r = K.consistency(F.col("ocr_text"), F.col("claim_texts"), F.col("raw_text"), F.col("match_verdict"), F.lit(None).cast("int"), F.col("image_verdict"))
    some = F.col("claim_texts").isNotNull()
    return rows.withColumn("r", r).select(*facts.columns, F.when(some, F.col("r.score")).alias("consistency"), F.when(some, F.col("r.flags")).alias("flags"))


def image_only(submissions: DataFrame, facts: DataFrame) -> DataFrame:
    """(submission_id, claim_verdict, overall_status, confidence) of submissions with an image and no text at all, in or beside it."""
    bare = submissions.where((F.col("input_type") == "image") & (T.strip(T.text("text")) == ""))
    rows = bare.withColumn("key__", F.col("submission_id").cast("string")).join(facts.withColumnRenamed("submission_id", "key__"), "key__")
    return rows.select("submission_id", V.image_only_verdict(F.col("image_verdict"), F.col("image_confidence")).alias("v")).select("submission_id", "v.*")
