"""Lemmas, keywords and subject-verb-object triples by suffix rules; a tagger is a backend."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators.claims import VERB_ENDING, VERBS

# Irregular forms.
IRREGULAR = {"was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "did": "do", "does": "do", "went": "go", "gone": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "held": "hold", "won": "win", "lost": "lose", "men": "man", "women": "woman", "children": "child", "people": "people"}
ADJECTIVE_ENDING = r"(?:ous|ful|ive|less|able|ible|ical|ish|ary)$"


def lemma(word: Column) -> Column:
    """Base form of a lower-case word, by an irregular list, then one suffix rule."""

    def rules(w: Column) -> Column:
        known = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
        cut = lambda n, add="": F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(add))
        suffix = (
            F.when(w.rlike("ies$") & (F.length(w) > 4), cut(3, "y"))
            .when(w.rlike("(?:ss|us|is)$"), w)
            .when(w.rlike("(?:s|x|z|ch|sh)es$") & (F.length(w) > 4), cut(2))
            .when(w.rlike("s$") & (F.length(w) > 3), cut(1))
            .when(w.rlike("([bdfgmnprt])\\1ing$") & (F.length(w) > 6), cut(4))
            .when(w.rlike("(?:at|iz|bl|s|v|c|g)ing$") & (F.length(w) > 5), cut(3, "e"))
            .when(w.rlike("ing$") & (F.length(w) > 5), cut(3))
            .when(w.rlike("ied$") & (F.length(w) > 4), cut(3, "y"))
            .when(w.rlike("([bdfgmnprt])\\1ed$") & (F.length(w) > 5), cut(3))
            .when(w.rlike("(?:at|iz|bl|s|v|c|g)ed$") & (F.length(w) > 4), cut(1))
            .when(w.rlike("ed$") & (F.length(w) > 4), cut(2))
            .otherwise(w)
        )
        return F.coalesce(known[w], suffix)

    return T.let(word, rules)


def lemmas(c: Column) -> Column:
    """Base forms of the words that aren't stop words, in order."""
    found = F.regexp_extract_all(F.lower(T.text(c)), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    return F.transform(F.filter(found, lambda w: ~w.isin(T.STOP)), lemma)


def _is_verb(w: Column) -> Column:
    return w.isin(VERBS) | w.rlike(VERB_ENDING)


def keywords(c: Column) -> Column:
    """Distinct words other than stop words: nouns, then verbs, then adjectives."""
    found = F.array_distinct(F.filter(T.tokens(T.text(c)), lambda w: (F.length(w) > 1) & ~w.isin(T.STOP)))

    def kinds(v: Column) -> Column:
        verb = F.filter(v, _is_verb)
        adjective = F.filter(v, lambda w: ~_is_verb(w) & w.rlike(ADJECTIVE_ENDING))
        return F.concat(F.filter(v, lambda w: ~_is_verb(w) & ~w.rlike(ADJECTIVE_ENDING)), verb, adjective)

    return T.let(found, kinds)


def triple(c: Column) -> Column:
    """struct(subject, predicate, object) around the first verb that follows a word; nulls without one."""
    w = T.words(F.regexp_replace(T.text(c), r"[.!?]+\s*$", ""))

    def cut(v: Column) -> Column:
        at = F.array_position(F.transform(v, lambda x, i: (i > 0) & _is_verb(F.lower(x))), F.lit(True)).cast("int")
        part = lambda a, n: F.array_join(F.slice(v, a, n), " ")
        some = lambda x: F.when((at > 0) & (x != ""), x)
        return F.struct(some(part(F.lit(1), F.greatest(at - 1, F.lit(0)))).alias("subject"), F.when(at > 0, F.get(v, at - 1)).alias("predicate"), some(part(at + 1, F.greatest(F.size(v) - at, F.lit(0)))).alias("object"))

    return T.let(w, cut)


#: Texts from this length on have frequent characters that difflib leaves out; they go to it.
LONG = 200


def matching_ratio(a: str, b: str) -> float:
    """difflib's ratio of two texts. Short ones as one number, whose bit i * w + j says that a[i] is b[j].

    A number and itself, moved along the diagonal, have in common where longer
    equal parts start; the lowest bit is the part that difflib takes.
    """
    if len(b) >= LONG or not a or not b:
        return difflib.SequenceMatcher(None, a, b).ratio()
    size = (len(b) + 8) // 8  # bytes of a row, of which one bit at least is free
    w = 8 * size
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    rows, none = {c: v.to_bytes(size, "little") for c, v in places.items()}, bytes(size)
    each = int.from_bytes((b"\1" + none[1:]) * len(a), "little")
    work, matches = [int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")], 0
    while work:
        x = work.pop()
        if not x:
            continue
        powers = [x]
        while y := powers[-1] & (powers[-1] >> ((w + 1) << (len(powers) - 1))):
            powers.append(y)
        start, k = powers[-1], 1 << (len(powers) - 1)
        for n in range(len(powers) - 2, -1, -1):
            if y := start & (powers[n] >> ((w + 1) * k)):
                start, k = y, k + (1 << n)
        i, j = divmod((start & -start).bit_length() - 1, w)
        matches += k
        work.append(x & ((1 << (i * w)) - 1) & (each * ((1 << j) - 1)))
        work.append((x >> ((i + k) * w)) & (each * ((1 << len(b)) - (1 << (j + k)))))
    return 2.0 * matches / (len(a) + len(b))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of matching blocks of two lower-cased texts (difflib's ratio), 0 if one is empty."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([matching_ratio(p, q) if p and q else 0.0 for p, q in zip(x, y)])

    return F.pandas_udf(run, "double")(F.lower(T.text(a)), F.lower(T.text(b)))
