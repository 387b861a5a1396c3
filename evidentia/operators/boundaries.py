"""Sentence boundaries learnt from the corpus without supervision (after Kiss and Strunk, 2006).

A word that is nearly always followed by a period is an abbreviation; a word
that follows sentence ends more often than chance is a starter; a number or an
initial and the word behind it may be a collocation. All three are decided by
log-likelihood ratios of counts over all documents of a language. Counts are
summed in partial aggregates, so frequent words are one row a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.plans.storage import kept

# Thresholds of the published method, and the share of periods it assumes behind abbreviations.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
DOTTED = 0.99

NUMBER = "##"
#: Tables of learnt words up to this many rows go to all tasks; larger ones are joined.
SENT_ROWS = 200_000


@dataclass
class Learnt:
    """(lang, word) of abbreviations and starters, (lang, word, following) of collocations, (lang, word) of words
    that are capitalised only at the beginning of sentences."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    lower: DataFrame


def _bare(w: Column) -> Column:
    """A token without opening and closing marks around it."""
    return F.regexp_replace(w, r"^[(\"'\[]+|[)\"'\],;:]+$", "")


def _type(bare: Column) -> Column:
    """Lower-case word without its final period; numbers are one type, tokens without letter or digit are empty."""
    word = F.lower(F.regexp_replace(bare, r"\.$", ""))
    return F.when(word.rlike(r"^[0-9][0-9.,]*$"), NUMBER).when(word.rlike(r"[\p{L}\p{N}]"), word).otherwise("")


def neighbours(documents: DataFrame) -> DataFrame:
    """documents (text, lang) -> one row per word between white space: lang (null: und), w, and p, the one before
    (null for a text's first)."""
    split = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), T.words(T.text("text")).alias("w")).where(F.size("w") > 0)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.size("w") - 1))
    return split.select("lang", F.explode(F.arrays_zip(F.col("w").alias("w"), before.alias("p"))).alias("t")).select("lang", "t.w", "t.p")


def _dot(bare: Column) -> Column:
    return bare.endswith(".") & ~bare.endswith("..")


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n, n_dot, n_lower, n_capital_inside): occurrences, with a period behind, in lower case, and with
    a capital although no sentence end comes before. Spellings are counted first, then brought to types."""
    spelt = neighbours(documents).groupBy("lang", "w", F.col("p").rlike(r"[.!?][)\"'\],;:]*$").alias("begins")).agg(F.count("*").alias("k"))
    rows = spelt.select("lang", "begins", "k", _bare(F.col("w")).alias("b")).select("lang", _type(F.col("b")).alias("word"), _dot(F.col("b")).alias("dot"), F.col("b").rlike(r"^\p{Lu}").alias("capital"), "begins", "k")
    total = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    return rows.where(F.col("word") != "").groupBy("lang", "word").agg(
        F.sum("k").alias("n"), total(F.col("dot")).alias("n_dot"), total(~F.col("capital")).alias("n_lower"),
        total(F.col("capital") & F.col("begins").eqNullSafe(False)).alias("n_capital_inside"),
    )


def period_words(counts: DataFrame) -> DataFrame:
    """Words that come with a period: lang, word, n, n_dot, score, abbreviation.

    score: the log-likelihood ratio of "nearly always with a period" against
    "as often as any word", times factors for short words and inner periods,
    less where the word comes without period. Numbers are no abbreviations.
    """
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("n_dot").alias("dots"))
    rows = counts.where((F.col("n_dot") > 0) & (F.col("word") != NUMBER)).join(F.broadcast(totals), "lang")
    p = F.least(F.col("dots") / F.col("all"), F.lit(1 - 1e-9))
    without = F.col("n") - F.col("n_dot")
    chance = F.col("n_dot") * F.ln(p) + without * F.ln(1 - p)
    always = F.col("n_dot") * F.ln(F.lit(DOTTED)) + without * F.ln(F.lit(1 - DOTTED))
    letters = F.length(F.replace("word", F.lit(".")))
    score = -2 * (chance - always) * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -without)
    return rows.select("lang", "word", "n", "n_dot", T.floor_to(score, 4).alias("score"), (T.floor_to(score, 4) >= ABBREVIATION).alias("abbreviation"))


def dotted_pairs(documents: DataFrame) -> DataFrame:
    """(lang, word, following, n): words with a period and the word behind it."""
    spelt = neighbours(documents).where(F.col("p").rlike(r"\.[)\"'\],;:]*$")).groupBy("lang", "p", "w").agg(F.count("*").alias("k"))
    rows = spelt.select("lang", _bare(F.col("p")).alias("p"), _type(_bare(F.col("w"))).alias("following"), "k")
    rows = rows.where(_dot(F.col("p"))).select("lang", _type(F.col("p")).alias("word"), "following", "k")
    return rows.where("word != '' and following != ''").groupBy("lang", "word", "following").agg(F.sum("k").alias("n"))


def likelihood(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's ratio that b comes behind a by more than chance; of n words a are the one, b the other; 0 where it is less."""

    def log(k: Column, m: Column, p: Column) -> Column:
        q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        return k * F.ln(q) + (m - k) * F.ln(1 - q)

    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    ratio = 2 * (log(both, a, p1) + log(b - both, n - a, p2) - log(both, a, p) - log(b - both, n - a, p))
    return F.when(p1 > p, ratio).otherwise(0.0)


def starters(counts: DataFrame, pairs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Words that begin sentences more often than chance: lang, word, n, n_after, ratio."""
    ends = pairs.join(abbreviations, ["lang", "word"], "left_anti").where(~F.col("word").rlike(r"^(?:\p{L}|##)$"))
    after = ends.groupBy("lang", F.col("following").alias("word")).agg(F.sum("n").alias("n_after"))
    breaks = ends.groupBy("lang").agg(F.sum("n").alias("breaks")).join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang")
    rows = after.join(counts.select("lang", "word", "n"), ["lang", "word"]).join(F.broadcast(breaks), "lang")
    ratio = T.floor_to(likelihood(F.col("breaks"), F.col("n"), F.col("n_after"), F.col("all")), 2)
    return rows.select("lang", "word", "n", "n_after", ratio.alias("ratio")).where(F.col("ratio") >= STARTER)


def collocations(counts: DataFrame, pairs: DataFrame, begin: DataFrame) -> DataFrame:
    """Numbers or initials and words behind their period that belong together: lang, word, following."""
    rows = pairs.where(F.col("word").rlike(r"^(?:\p{L}|##)$")).withColumnRenamed("n", "both")
    one, other = counts.select("lang", "word", F.col("n").alias("a")), counts.select("lang", F.col("word").alias("following"), F.col("n").alias("b"))
    rows = rows.join(one, ["lang", "word"]).join(other, ["lang", "following"]).join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("all"))), "lang")
    rows = rows.join(begin.select("lang", F.col("word").alias("following")), ["lang", "following"], "left_anti")
    return rows.where(likelihood(F.col("a"), F.col("b"), F.col("both"), F.col("all")) >= COLLOCATION).select("lang", "word", "following")


def learn(documents: DataFrame) -> Learnt:
    """Statistics over all documents (text, lang); the counts are written once."""
    counts, pairs = kept(word_counts(documents)), kept(dotted_pairs(documents))
    short = kept(period_words(counts).where("abbreviation").select("lang", "word"))
    begin = kept(starters(counts, pairs, short).select("lang", "word"))
    return Learnt(short, begin, kept(collocations(counts, pairs, begin)), kept(counts.where("n_lower > 0 and n_capital_inside = 0").select("lang", "word")))


def _flagged(rows: DataFrame, known: DataFrame, on: list[str], name: str) -> DataFrame:
    side = known.withColumn(name, F.lit(True))
    few = known.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return rows.join(F.broadcast(side) if few else side, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def sentences(documents: DataFrame, learnt: Learnt) -> DataFrame:
    """documents (doc_id, text, lang) -> doc_id, sent_ix (from 0), sentence.

    Cuts are those of T.sentences less the ones behind abbreviations (unless a
    starter, or a word with a capital only sentence ends explain, follows),
    behind numbers before a word in lower case, behind initials before a name,
    and inside collocations. One space stands where a cut is taken back. Null
    and empty texts have no row; repeated doc_ids and null ones keep apart.
    """
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), T.sentences(T.text("text")).alias("s"))
    behind = F.concat(F.slice("s", 2, F.size("s")), F.array(F.lit(None).cast("string")))
    rows = docs.where(F.size("s") > 0).select("row", "doc_id", "lang", F.posexplode(F.arrays_zip(F.col("s").alias("piece"), behind.alias("next"))).alias("ix", "t")).select("row", "doc_id", "lang", "ix", "t.piece", "t.next")
    last, first = _bare(F.regexp_extract("piece", r"\S+$", 0)), _bare(F.regexp_extract("next", r"^\S+", 0))
    rows = rows.select("row", "doc_id", "lang", "ix", "piece", F.col("next").isNull().alias("end"), (last.endswith(".") & ~last.endswith("..")).alias("dot"), _type(last).alias("word"), _type(first).alias("following"), first.rlike(r"^\p{Lu}").alias("capital"), first.rlike(r"^\p{Ll}").alias("small"))
    rows = _flagged(rows, learnt.abbreviations, ["lang", "word"], "short")
    rows = _flagged(rows, learnt.starters.withColumnRenamed("word", "following"), ["lang", "following"], "begins")
    rows = _flagged(rows, learnt.lower.withColumnRenamed("word", "following"), ["lang", "following"], "common")
    rows = _flagged(rows, learnt.collocations, ["lang", "word", "following"], "together")
    initial = F.col("word").rlike(r"^\p{L}$")
    goes_on = (
        (F.col("short") & (F.col("small") | (~F.col("begins") & ~(F.col("capital") & F.col("common")))))
        | F.col("together")
        | ((F.col("word") == NUMBER) & F.col("small"))
        | (initial & F.col("capital") & ~F.col("common") & ~F.col("begins"))
    )
    rows = rows.withColumn("cut", F.col("end") | ~F.col("dot") | ~F.coalesce(goes_on, F.lit(False)))
    order = Window.partitionBy("row").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sent_ix", F.coalesce(F.sum(F.col("cut").cast("int")).over(order), F.lit(0)))
    parts = rows.groupBy("row", "doc_id", "sent_ix").agg(F.sort_array(F.collect_list(F.struct("ix", "piece"))).alias("p"))
    return parts.select("doc_id", F.col("sent_ix").cast("int").alias("sent_ix"), F.array_join("p.piece", " ").alias("sentence"))
