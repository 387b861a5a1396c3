"""Word and text polarity from a lexicon of valences, a table (word, valence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T

ALPHA, EDGE = 15.0, 0.05

# A small lexicon of our own, valences from -4 to 4.
LEXICON = {
    "good": 1.9, "great": 3.1, "best": 3.2, "win": 2.8, "wins": 2.7, "love": 3.2, "peace": 2.5, "support": 1.7, "hope": 1.9, "safe": 1.9, "credibility": 1.5, "honest": 2.3, "success": 2.7,
    "bad": -2.5, "worst": -3.1, "war": -2.9, "attack": -2.1, "accuses": -1.5, "problem": -1.7, "crisis": -3.1, "death": -2.9, "kill": -3.7, "fraud": -2.8, "fake": -2.1, "fear": -2.2, "hate": -2.7, "lost": -1.3, "fire": -1.4,
    "idiot": -2.3, "stupid": -2.4, "disgusting": -2.4, "pathetic": -2.6, "worthless": -1.9, "trash": -1.8, "loser": -2.4, "moron": -2.0, "scum": -2.5, "clown": -0.6,
}


def compound(total: Column) -> Column:
    return total / F.sqrt(total * total + ALPHA)


def _valences() -> Column:
    return F.create_map(*[F.lit(x) for kv in LEXICON.items() for x in kv])


def polar_words(c: Column) -> tuple[Column, Column]:
    """Cleaned words above EDGE and below -EDGE by their compound, in order."""
    words = T.plain_words(T.text(c))
    score = lambda w: compound(F.coalesce(_valences()[w], F.lit(0.0)))
    return F.filter(words, lambda w: score(w) > EDGE), F.filter(words, lambda w: score(w) < -EDGE)


def score_table(rows: DataFrame, lexicon: DataFrame, key: str, column: str) -> DataFrame:
    """(key, total, compound, n_positive, n_negative) per row with cleaned words, against a lexicon table of any size."""
    words = rows.select(key, F.explode(T.plain_words(T.text(column))).alias("word"))
    met = words.join(lexicon.select("word", "valence"), "word", "left").withColumn("valence", F.coalesce("valence", F.lit(0.0)))
    one = compound(F.col("valence"))
    out = met.groupBy(key).agg(F.sum("valence").alias("total"), F.count_if(one > EDGE).alias("n_positive"), F.count_if(one < -EDGE).alias("n_negative"))
    return out.select(key, "n_positive", "n_negative", T.floor_to(compound(F.col("total")), 6).alias("compound"))


def stage_one(records: DataFrame) -> DataFrame:
    """records (id, label, title, ocr_text) -> id, label, text, words, positive, negative, compound; a blank ocr_text falls back to the title."""
    text = F.when(T.strip(T.text("ocr_text")) != "", F.col("ocr_text")).otherwise(T.text("title"))
    pos, neg = polar_words(text)
    total = F.aggregate(F.transform(T.plain_words(text), lambda w: F.coalesce(_valences()[w], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return records.select("id", "label", text.alias("text"), T.plain_words(text).alias("words"), pos.alias("positive_words"), neg.alias("negative_words"), T.floor_to(compound(total), 4).alias("compound"))
