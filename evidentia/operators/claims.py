"""Claims: extraction, quality gate, search queries, hit acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions import urls as U

# Labels of a page that are no claim.
LABELS = ["TOP STORIES", "BREAKING NEWS", "UPDATE", "LIVE", "VIEWS", "REPLY", "SHARE", "LIKE"]
# Clause joints at which a sentence may hold two claims, and conjunctions that keep it whole.
JOINTS = ["but", "while", "which"]
KEPT = ["therefore", "because", "so", "thus", "hence"]
#: A clause is a claim if it has a verb: one of these words, or a word with such an ending.
VERBS = [
    "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "shall", "should", "may", "might", "must",
    "say", "says", "said", "see", "sees", "saw", "go", "goes", "went", "make", "makes", "made", "take", "takes", "took", "give", "gives", "gave", "get", "gets", "got",
    "come", "comes", "came", "know", "knows", "knew", "think", "thinks", "thought", "find", "finds", "found", "hold", "holds", "held", "keep", "keeps", "kept", "lose",
    "loses", "lost", "win", "wins", "won", "sign", "signs", "pay", "pays", "paid", "meet", "meets", "met", "run", "runs", "ran", "rise", "rises", "rose", "fall",
    "falls", "fell", "hit", "hits", "cut", "cuts", "put", "puts", "let", "lets", "set", "sets", "build", "builds", "built", "ban", "bans", "die", "dies", "kill",
    "kills",
]
VERB_ENDING = r"^[a-z]{2,}(?:ed|ing|ises|izes|ises|ifies)$"
QUERY_CAP = 5


def reject_reason(claim: Column) -> Column:
    """Null for a valid claim. Every label has fewer than three words, so the last rule never decides."""
    c = T.text(claim)
    letters = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}_\x{0900}-\x{097F}]", ""))
    return (
        F.when(F.size(T.words(c)) < 3, "Too few words to be a claim.")
        .when(letters < 0.35 * F.length(c), "Contains excessive non-alphanumeric noise.")
        .when(F.upper(T.strip(c)).isin(LABELS), "Appears to be a UI or navigation label.")
    )


def gate(claims: DataFrame, column: str = "claim") -> DataFrame:
    """Adds status (VALID or INVALID_CLAIM) and reject_reason."""
    return claims.withColumn("reject_reason", reject_reason(F.col(column))).withColumn("status", F.when(F.col("reject_reason").isNull(), "VALID").otherwise("INVALID_CLAIM"))


def split_clauses(sentence: Column) -> Column:
    joints = "|".join([rf", and (?!{'|'.join(KEPT)})", *(f", {j} " for j in JOINTS)])
    return F.filter(F.transform(F.split(sentence, f"(?i){joints}"), T.strip), lambda p: p != "")


def has_verb(clause: Column) -> Column:
    return F.exists(F.transform(T.words(F.lower(clause)), lambda w: F.regexp_replace(w, r"[^\p{L}']", "")), lambda w: w.isin(VERBS) | w.rlike(VERB_ENDING))


def extract(texts: DataFrame, column: str = "text") -> DataFrame:
    """One row per claim: the columns of texts, claim_ix, claim.

    Sentences of four or more words that ask nothing are cut into clauses;
    clauses of four words with a verb are claims. A text without any is one
    claim if it has three words and asks nothing.
    """
    c = T.strip(T.text(column))
    stated = F.filter(T.sentences(c), lambda s: (F.size(T.words(s)) >= 4) & ~s.endswith("?"))
    clauses = F.filter(F.flatten(F.transform(stated, split_clauses)), lambda p: (F.size(T.words(p)) >= 4) & has_verb(p))
    whole = F.when((F.size(T.words(c)) >= 3) & ~c.endswith("?"), F.array(c)).otherwise(F.array().cast("array<string>"))
    return texts.select("*", F.posexplode(F.when(F.size(clauses) > 0, clauses).otherwise(whole)).alias("claim_ix", "claim"))


def confidence(claim: Column, ocr_confidence: Column, from_model: bool = False) -> Column:
    base = F.coalesce(ocr_confidence, F.lit(0.6 if from_model else 0.5)) + F.when(F.size(T.words(T.text(claim))) > 6, 0.1).otherwise(0.0)
    return T.floor_to(F.least(base, F.lit(1.0)), 2)


def with_queries(claims: DataFrame, column: str = "claim", names: str | None = None, locations: str | None = None, concepts: str | None = None) -> DataFrame:
    """Adds queries, at most QUERY_CAP: quoted, core, entities, fact check, two social sites, year; in this order.

    names, locations, concepts: columns of string arrays, or None. The parts
    are columns of their own on the way, so each is computed once per row.
    """
    none = F.array().cast("array<string>")
    parts = F.concat(*[F.slice(F.coalesce(F.col(x), none) if x else none, 1, n) for x, n in ((names, 2), (locations, 1), (concepts, 1))])
    c, w, kept, key = (F.col(x) for x in ("q_text__", "q_words__", "q_kept__", "q_key__"))
    bare = lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}$\x{20B9}]+|[^\p{L}\p{N}%]+$", "")
    rows = claims.withColumn("q_text__", T.strip(T.text(column))).withColumn("q_words__", T.words(c))
    rows = rows.withColumn("q_kept__", F.filter(F.transform(w, bare), lambda x: (F.length(x) > 1) & ~F.lower(x).isin(T.STOP)))
    some = F.size(kept) > 0
    rows = rows.withColumn("q_key__", F.array_join(F.when(some, F.slice(kept, 1, 5)).otherwise(F.slice(w, 1, 4)), " "))
    quoted = F.size(w).between(4, 7) & ~c.rlike(r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}]")
    year = T.query_year(c)
    queries = F.array(
        F.when(quoted, F.concat(F.lit('"'), c, F.lit('"'))),
        F.array_join(F.when(some, F.slice(kept, 1, 7)).otherwise(F.slice(w, 1, 6)), " "),
        F.when(F.size(parts) > 0, F.substring(F.array_join(parts, " "), 1, 60)),
        F.concat(key, F.lit(" fact check")),
        F.when(key != "", F.concat(F.lit("(site:x.com OR site:twitter.com) "), key)),
        F.when(key != "", F.concat(F.lit("(site:instagram.com OR site:reddit.com) "), key)),
        F.when(year.isNotNull(), F.concat(key, F.lit(" "), year)),
    )
    rows = rows.withColumn("q_all__", F.transform(F.array_compact(queries), T.strip)).withColumn("q_low__", F.transform("q_all__", F.lower))
    first = F.filter("q_all__", lambda q, i: (q != "") & (F.array_position("q_low__", F.get("q_low__", i)) == i + 1))
    rows = rows.withColumn("queries", F.when(c == "", none).otherwise(F.slice(first, 1, QUERY_CAP)))
    return rows.drop("q_text__", "q_words__", "q_kept__", "q_key__", "q_all__", "q_low__")


def usable_queries(queries: Column) -> Column:
    return F.filter(queries, lambda q: F.length(T.strip(q)) >= 4)


def routed_queries(queries: Column) -> Column:
    """Up to two web and two social queries; the first three where neither kind is left."""
    social = lambda q: q.startswith("(site:") | q.startswith("site:")
    chosen = F.concat(F.slice(F.filter(queries, lambda q: ~social(q)), 1, 2), F.slice(F.filter(queries, social), 1, 2))
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(queries, 1, 3))


def accept_hits(hits: DataFrame, least: int = 1) -> DataFrame:
    """hits (claim_id, claim, q_ord, hit_ord, url, title, snippet) -> accepted rows with rank.

    A hit counts if its URL is social, the claim has no long word, or at least
    `least` long words recur in title and snippet; of accepted hits of one URL
    the first counts. Rows without URL go.
    """
    own = F.array_distinct(T.key_words(T.text("claim")))
    found = F.array_distinct(T.key_words(F.concat_ws(" ", T.text("title"), T.text("snippet"))))
    fits = U.is_social(F.col("url")) | (F.size(own) == 0) | (F.size(F.array_intersect(own, found)) >= least)
    kept = hits.where((T.text("url") != "") & fits)
    seen = Window.partitionBy("claim_id", "url").orderBy("q_ord", "hit_ord")
    first = kept.withColumn("seen__", F.row_number().over(seen)).where("seen__ = 1").drop("seen__")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy("q_ord", "hit_ord", "url")))
