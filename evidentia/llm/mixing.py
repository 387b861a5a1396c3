"""Mixing sources to target weights, in DataFrame operations only.

Efraimidis-Spirakis sampling: a document's key is an exponential variate
divided by its quality weight; sorted by key within the source, documents are
taken until the prefix sum of their words meets the source's budget. A target
above the source's size first takes complete epochs, and the key order selects
only the fraction that remains.

Prefix sums run on two levels, so no source is ever sorted in one task: keys
fall into ranges of the key's distribution, ranges are summed per
source, and rows are ordered only inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import written

#: Weights of the sources in code-point order (null last), repeating.
PATTERN = (5, 2, 1)
#: The mix's words against all words, and a source's largest share against its own.
SHARE, CAP = 1.5, 2
#: Key ranges of a source: at least so many, and one for so many rows of the table.
RANGES, ROWS = 4096, 2_000
WORDS = r"[^\x20\x09-\x0D]+"
#: Weight of a document in its source's order by its quality label.
GOOD, PLAIN, POOR = 2.0, 1.0, 0.5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from 52 bits of the MD5 of the id, or of the text where there is none; the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels; several labels of a document count as their best."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") >= 1, GOOD).otherwise(POOR).alias("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (no_source, src, source_size), one row per source -> with target.

    Sources share SHARE of all words by weight; none exceeds CAP times its
    size, and what it can't use is shared again. Sorted by CAP * size / weight,
    the capped sources are a prefix, so two prefix sums replace the iteration.
    """
    everything = Window.orderBy("no_source", "src")
    w = F.element_at(F.array(*[F.lit(x) for x in PATTERN]), ((F.row_number().over(everything) - 1) % len(PATTERN) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("most", F.col("source_size") * CAP)
    order = Window.orderBy(F.col("most") / F.col("w"), "no_source", "src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double")) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("most"))
    # the first source below its cap fixes the level of all that follow
    ranked = ranked.withColumn("level", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.select("no_source", "src", "source_size", F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("level") * F.col("w"), F.col("most").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, epochs, selected.

    size: words of the text (null and empty: 0, never taken). taken: size times
    the complete epochs, once more if the key order selects the row; a row is
    selected if the middle of its words lies within the budget, so a source
    misses its target by half a document at most. weights: (doc_id, weight > 0);
    missing, null and other weights count as 1. Rows of equal key order by
    doc_id, then size. A null source is a source of its own, the last. Empty
    tables give empty results; other columns are ignored, but for also, which
    are returned as they are.
    """
    kept = docs.select(*also).columns
    rows = docs.select(*also, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), n_words(F.col("text")).alias("size"), _uniform(F.col("doc_id"), F.col("text")).alias("draw"))
    if weights is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        own = weights.where("weight > 0").groupBy(F.col("doc_id").alias("w_id")).agg(F.max("weight").cast("double").alias("weight"))
        rows = rows.join(own, F.col("doc_id") == F.col("w_id"), "left").drop("w_id")
    key = -F.log(F.col("draw")) / F.coalesce("weight", F.lit(1.0))
    rows = rows.withColumn("key", key).drop("weight", "draw")
    n_ranges = max(RANGES, docs.count() // ROWS)
    rows = written(rows.withColumn("rng", F.floor((1 - F.exp(-F.col("key"))) * n_ranges).cast("int")))

    source = ["no_source", "src"]
    sums = written(rows.groupBy(*source, "rng").agg(F.sum("size").alias("words")))
    goals = targets(sums.groupBy(*source).agg(F.sum("words").alias("source_size")))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy(*source).orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.withColumn("before", before).join(goals, source)
    inside = F.sum("size").over(Window.partitionBy(*source, "rng").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("upto", inside).join(ranges.select(*source, "rng", "before", "source_size", "target", "epochs", "budget"), [*source, "rng"])
    selected = (F.col("before") + F.col("upto") - F.col("size") / 2) <= F.col("budget")
    placed = placed.withColumn("selected", selected & (F.col("size") > 0))
    return placed.select(*kept, "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("selected").cast("long"))).alias("taken"), "epochs", "selected")


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """docs, each row as often as the mix takes it; all columns stay.

    Rows are told apart by a 64-bit hash of id, source and text, so null and
    repeated doc_ids are mixed like others; docs has no full repeats.
    """
    # xxhash64 skips nulls, so these are told apart by flags
    row = F.xxhash64(*[c for n in ("doc_id", "source", "text") for c in (F.col(n).isNull(), F.col(n))])
    copies = mix(docs, weights, (row.alias("mix_row__"),)).where("taken > 0").select("mix_row__", (F.col("taken") / F.col("size")).cast("int").alias("mix_copies__"))
    out = docs.withColumn("mix_row__", row).join(copies, "mix_row__")
    return out.withColumn("mix_copies__", F.explode(F.sequence(F.lit(1), F.col("mix_copies__")))).select(*docs.columns)
