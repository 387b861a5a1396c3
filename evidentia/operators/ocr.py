"""What follows text recognition: region filters, reading order, the choice among engines.

Recognition itself is a backend: a table of regions (image_id, engine,
variant, text, confidence, center_x, center_y) is where these operators begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T

STATUS = r"^(?:[0-9]{1,3}\s*%|(?:4g|5g|lte|volte|wifi|3g|e|h\+)|[0-9]{1,2}:[0-9]{2}(?:\s*(?:am|pm))?)$"
LINE = 24
SURE, GOOD_ENOUGH = 0.8, 0.88


def is_status_line(c: Column) -> Column:
    """Battery, carrier or clock of a phone's status line; empty texts too."""
    s = F.lower(T.strip(T.text(c)))
    return (s == "") | s.rlike(STATUS)


def regions(found: DataFrame) -> DataFrame:
    """Cleaned regions without status lines and single characters other than digits; adds reliability."""
    rows = found.withColumn("text", T.clean_ocr(T.text("text")))
    kept = rows.where(((F.length("text") >= 2) | F.col("text").rlike("[0-9]")) & ~is_status_line(F.col("text")))
    return kept.withColumn("reliability", F.when(F.col("confidence") > SURE, "HIGH").otherwise("LOW"))


def reading_order(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): regions joined by spaces, top to bottom in lines of LINE pixels, left to right; ties by text."""
    line = F.rint(F.col("center_y") / LINE) * LINE
    placed = F.sort_array(F.collect_list(F.struct(line.alias("line"), F.col("center_x").alias("x"), F.col("text").alias("text"))))
    return rows.where(T.text("text") != "").groupBy(*keys).agg(F.array_join(F.transform(placed, lambda r: r["text"]), " ").alias("text"))


def consensus(rows: DataFrame) -> DataFrame:
    """The best reading of each image: engine and variant of the highest mean confidence (ties by name).

    Result: image_id, status, engine_used, overall_confidence, n_regions, text,
    has_devanagari. Images whose readings are all empty have no row here.
    """
    mean = rows.groupBy("image_id", "engine", "variant").agg(F.avg("confidence").alias("mean"), F.count("*").alias("n"))
    best = mean.groupBy("image_id").agg(F.max_by(F.struct("engine", "variant", "mean", "n"), F.struct(F.col("mean"), F.col("engine"), F.col("variant"))).alias("b")).select("image_id", "b.*")
    text = reading_order(rows, "image_id", "engine", "variant")
    out = best.join(text, ["image_id", "engine", "variant"], "left")
    return out.select("image_id", F.lit("SUCCESS").alias("status"), F.concat_ws("-", "engine", "variant").alias("engine_used"), T.floor_to(F.col("mean"), 3).alias("overall_confidence"), F.col("n").alias("n_regions"), T.text("text").alias("text"), T.has_devanagari(T.text("text")).alias("has_devanagari"))
