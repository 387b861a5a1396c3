"""Text functions as Column expressions.

Python's \\w has no combining marks and Java's is ASCII, so word characters are
spelled out once, here. Null and empty texts are the same to every function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_\x{0900}-\x{097F}]"
SENTENCE_END = "\u0001"

# Contractions and what they stand for.
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "can't": "cannot", "won't": "will not",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "haven't": "have not",
    "hasn't": "has not", "hadn't": "had not", "i'm": "i am", "you're": "you are", "he's": "he is",
    "she's": "she is", "it's": "it is", "we're": "we are", "they're": "they are", "that's": "that is",
}

# Words without meaning of their own, for keyword overlap.
OVERLAP_STOP = [
    "the", "a", "an", "is", "in", "on", "at", "to", "of", "and", "or", "for", "with", "that", "this", "it", "as", "was", "be", "by", "from",
]

# Common English function words.
STOP = [
    "a", "about", "above", "across", "after", "afterwards", "again", "against", "all", "almost", "alone", "along", "already", "also", "although", "always", "am",
    "among", "amongst", "an", "and", "another", "any", "anyhow", "anyone", "anything", "anyway", "anywhere", "are", "around", "as", "at", "back", "be", "became",
    "because", "become", "becomes", "becoming", "been", "before", "beforehand", "behind", "being", "below", "beside", "besides", "between", "beyond", "both", "but",
    "by", "can", "cannot", "could", "did", "do", "does", "done", "down", "due", "during", "each", "either", "else", "elsewhere", "enough", "even", "ever", "every",
    "everyone", "everything", "everywhere", "except", "few", "for", "former", "formerly", "from", "further", "get", "give", "go", "had", "has", "have", "he", "hence",
    "her", "here", "hereafter", "hereby", "herein", "hereupon", "hers", "herself", "him", "himself", "his", "how", "however", "i", "if", "in", "indeed", "into", "is",
    "it", "its", "itself", "just", "keep", "last", "latter", "latterly", "least", "less", "made", "make", "many", "may", "me", "meanwhile", "might", "mine", "more",
    "moreover", "most", "mostly", "much", "must", "my", "myself", "namely", "neither", "never", "nevertheless", "next", "no", "nobody", "none", "noone", "nor", "not",
    "nothing", "now", "nowhere", "of", "off", "often", "on", "once", "one", "only", "onto", "or", "other", "others", "otherwise", "our", "ours", "ourselves", "out",
    "over", "own", "part", "per", "perhaps", "please", "put", "quite", "rather", "re", "really", "same", "say", "see", "seem", "seemed", "seeming", "seems", "several",
    "she", "should", "show", "side", "since", "so", "some", "somehow", "someone", "something", "sometime", "sometimes", "somewhere", "still", "such", "take", "than",
    "that", "the", "their", "them", "themselves", "then", "thence", "there", "thereafter", "thereby", "therefore", "therein", "thereupon", "these", "they", "this",
    "those", "though", "through", "throughout", "thru", "thus", "to", "together", "too", "toward", "towards", "under", "unless", "until", "up", "upon", "us", "used",
    "using", "various", "very", "via", "was", "we", "well", "were", "what", "whatever", "when", "whence", "whenever", "where", "whereafter", "whereas", "whereby",
    "wherein", "whereupon", "wherever", "whether", "which", "while", "whither", "who", "whoever", "whole", "whom", "whose", "why", "will", "with", "within", "without",
    "would", "yet", "you", "your", "yours", "yourself", "yourselves",
]


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it.

    Inside a lambda Spark evaluates an outer expression again for every
    element; a lambda's own variable is a plain reference.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Parts between white space; none of an empty text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case runs of word characters, Devanagari with its marks."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD + "+"), F.lit(0))


def key_words(c: Column) -> Column:
    """Tokens longer than three characters."""
    return F.filter(tokens(c), lambda w: F.length(w) > 3)


def contains_any(c: Column, needles: list[str]) -> Column:
    """Whether a text holds any of the needles, also inside words."""
    return let(c, lambda v: F.exists(F.array(*map(F.lit, needles)), lambda k: F.contains(v, k)))


def first_contained(c: Column, needles: list[str], n: int) -> Column:
    return F.slice(F.filter(F.array(*map(F.lit, needles)), lambda k: F.contains(c, k)), 1, n)


def sentences(c: Column) -> Column:
    """Sentences, cut after . ! or ? before white space; abbreviations are cut too."""
    marked = F.regexp_replace(strip(c), r"([.!?])\s+", "$1" + SENTENCE_END)
    return F.filter(F.transform(F.split(marked, SENTENCE_END), strip), lambda s: s != "")


def is_junk_sentence(s: Column) -> Column:
    low = F.lower(s)
    return (F.length(s) < 20) | low.startswith("http") | low.startswith("source:") | low.startswith("www.") | (F.contains(low, F.lit("http")) & (F.size(words(s)) < 5))


def years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0)), lambda y: y.cast("int"))


def query_year(c: Column) -> Column:
    """First year from 1900 to 2039, or null."""
    found = F.regexp_extract(c, r"\b(19[0-9][0-9]|20[0-3][0-9])\b", 1)
    return F.when(found != "", found)


def standalone_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?\b"), F.lit(0))


def has_devanagari(c: Column) -> Column:
    return c.rlike(r"[\x{0900}-\x{097F}]")


def clean_ocr(c: Column) -> Column:
    return collapse(c)


def plain_words(c: Column, stop: list[str] = STOP) -> Column:
    """Lower-case words without ASCII punctuation, stop words and single characters, in order."""
    bare = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.filter(words(bare), lambda w: (F.length(w) > 1) & ~w.isin(stop))


def expand_contractions(c: Column) -> Column:
    for short, long in CONTRACTIONS.items():
        c = F.regexp_replace(c, rf"(?i)\b{short}\b", long)
    return c


def normalize(c: Column, squeeze: bool = True) -> Column:
    """Cleaned text: control characters, tags, links, mail addresses and rare symbols go, contractions
    are spelled out, runs of a character are cut to two, tokens of an image reader's noise go.

    The curly apostrophe and combining marks are rare symbols here. The text
    should be in NFKC form, see nfkc(). squeeze=False keeps runs.
    """
    c = F.regexp_replace(c, r"[\x{200B}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"https?://\S+", " ")
    c = F.regexp_replace(c, r"\S+@\S+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s.,!?;:'\"()\[\]{}&#%*+\-=/<>\x{20B9}$\x{20AC}\x{00A3}@]", "")
    c = expand_contractions(c)
    if squeeze:
        c = F.regexp_replace(c, r"(?s)([^\n])\1{2,}", "$1$1")
    kept = F.filter(words(c), lambda w: ~is_noise_token(w))
    return collapse(F.replace(F.array_join(kept, " "), F.lit("\\n"), F.lit(" ")))


def is_noise_token(w: Column) -> Column:
    alone = w.isin("%", "$", "₹", "€", "£", "+", "-")
    return (~w.rlike(r"[\p{L}\p{N}]") & ~alone) | (w.rlike(r"^\p{L}$") & ~F.lower(w).isin("a", "i"))


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Unicode NFKC form; Spark has no built-in, so this is the one function that runs in Python."""
    return F.pandas_udf(_nfkc, "string")(c)


def keyword_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words over two characters that aren't stop words; 0 if a side has none."""

    def own(c: Column) -> Column:
        found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(OVERLAP_STOP)))

    def ratio(v: Column) -> Column:
        x, y = v["x"], v["y"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return let(F.struct(own(a).alias("x"), own(b).alias("y")), ratio)


def first_of_each(c: Column) -> Column:
    """Trimmed strings without empty ones and without later ones of equal lower case."""
    trimmed = F.filter(F.transform(c, strip), lambda q: q != "")
    lows = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda q, i: F.array_position(lows, F.lower(q)) == i + 1)


def floor_to(c: Column, digits: int) -> Column:
    """Half-up rounding that reads the same in every engine."""
    return F.floor(c * 10**digits + 0.5) / float(10**digits)
