"""Readers and sinks of the engine's inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import images as I

METADATA = "id string, file_path string, url string, label int, title string, subreddit string"
NEWS_TSV = (
    "row string, row_0 string, row_0_1 string, row_0_1_1 string, author string, clean_title string, created_utc double, domain string, hasImage boolean, id string, image_url string, "
    "linked_submission_id string, num_comments double, score double, subreddit string, title string, upvote_ratio double, `2_way_label` int, `3_way_label` int, `6_way_label` int"
)


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of image records."""
    return spark.read.schema(METADATA).option("multiLine", True).json(path)


def social_news(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated social news with a header; the first column has no name."""
    return spark.read.schema(NEWS_TSV).csv(path, sep="\t", header=True, enforceSchema=True)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content, sha256, reject): declared by their extension, judged by their first bytes."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), ext))
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), I.upload_reject(mime, F.col("content")).alias("reject"))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images as (id, height, width, nChannels, data); corrupt files are dropped."""
    decoded = spark.read.format("image").option("dropInvalid", True).load(path)
    return decoded.select(F.col("image.origin").alias("id"), "image.height", "image.width", "image.nChannels", "image.data")


def submissions(rows: DataFrame) -> DataFrame:
    """rows (id, raw_text, image_path) -> accepted and rejected submissions.

    Adds input_type, status and reject: 422 where there is neither text nor
    image; the text placeholder "string" is no text.
    """
    text = T.strip(T.text("raw_text"))
    text = F.when(F.lower(text) == "string", "").otherwise(text)
    kind = I.input_type(text, F.col("image_path"))
    return rows.withColumn("raw_text", text).withColumn("input_type", kind).withColumn("reject", F.when(kind.isNull(), "422:empty")).withColumn("status", F.when(kind.isNotNull(), "queued"))


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
