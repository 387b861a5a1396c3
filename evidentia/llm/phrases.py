"""Collocations by pattern growth over projected occurrences.

Each occurrence of a word points at the words that follow it inside its piece,
four at most. Sorted, the pointers of a prefix lie together and are its
projection; a frequent prefix is extended to the right inside its own
projection, depth first, and an infrequent one never. Tasks take ranges of
prefixes. As a range may end inside a prefix, a hot one belongs to several
tasks, whose counts of the prefixes they share are added afterwards.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.bpe_automaton import slices
from evidentia.llm.common import cached, ship, written

#: Words of a phrase at most; occurrences at least; per cent of a phrase's occurrences that a longer one must have to replace it; phrases told of a language.
WORDS, LEAST, COVERED, TOLD = 5, 100, 100, 2000
#: Frequent words that get numbers and are sent to all tasks. Where there are more, pointers hold the words themselves.
NUMBERED = 1 << 20
#: Words that a task gathers before it sorts them.
CHUNK = 1 << 20
SALTS = 32
_BITS = 21
_SPELT = "lang string, w0 string, w1 string, w2 string, w3 string, w4 string, n long"
_CODED = "lang string, k0 long, k1 long, n long"
#: A-Z are lowered, ends of pieces become line feeds, tabs spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for some in slices(batch):
            for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                if text:
                    yield lang, text.encode().translate(_TABLE)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words of docs, written to the shared folder."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                columns = [pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array(list(words.values()), pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
                yield from (whole.slice(i, 1 << 15) for i in range(0, len(words), 1 << 15))
            held.clear()

        size = 0
        for lang, data in _texts(batches):
            words = data.split()
            held.setdefault(lang, Counter()).update(words)
            size += len(words)
            if size > 2 * CHUNK:
                size = 0
                yield from rows()
        yield from rows()

    parts = _rows(docs).mapInArrow(count, "lang string, word string, n long")
    return written(parts.groupBy("lang", "word").agg(F.sum("n").alias("n")), texts=True)


def numbers(words: DataFrame, least: int, most: int) -> dict[str, list[str]] | None:
    """Of every language the words found least times or more, the most frequent first, or None where there are more than most of them."""
    many = words.where(F.col("n") >= least)
    if many.count() > most:
        return None
    out: dict[str, list[tuple[int, str]]] = {}
    for r in many.toLocalIterator():
        out.setdefault(r["lang"], []).append((-r["n"], r["word"]))
    return {lang: [w for _, w in sorted(found)] for lang, found in out.items()}


def _windows(ids: np.ndarray, starts: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of up to WORDS ids from each of the first starts places on, cut at 0, of two ids at least; and how often each occurs."""
    starts = min(starts, len(ids))
    ids = np.concatenate([ids, np.zeros(WORDS, ids.dtype)])
    at = np.flatnonzero((ids[:starts] > 0) & (ids[1 : starts + 1] > 0))
    columns = [ids[at], ids[at + 1]]
    for k in range(2, WORDS):
        columns.append(ids[at + k] * (columns[-1] > 0))
    k0 = columns[0] << 2 * _BITS | columns[1] << _BITS | columns[2]
    k1 = columns[3] << _BITS | columns[4]
    order = np.lexsort((k1, k0))
    k0, k1 = k0[order], k1[order]
    first = np.flatnonzero(np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])[: len(k0)])
    return [k0[first], k1[first]], np.diff(first, append=len(k0))


def _unpacked(k0: np.ndarray, k1: np.ndarray) -> list[np.ndarray]:
    low = (1 << _BITS) - 1
    return [k0 >> 2 * _BITS, k0 >> _BITS & low, k0 & low, k1 >> _BITS, k1 & low]


def pointers(docs: DataFrame, table: Broadcast) -> DataFrame:
    """Pointers that stand for two words or more, equal ones of a task counted together.

    With numbered words those words only, as longer phrases of others can't be
    frequent; pointers end before the first other word.
    """
    ship(docs.sparkSession)
    spelt = table.value[1] is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = table.value
        codes = None if spelt else cached(("phrases", key), lambda: {lang: {w.encode(): i for i, w in enumerate(words, 1)} for lang, words in found.items()})
        held: dict[str, list[int]] = {}
        local: dict[bytes, int] = {}  # without numbers of all tasks: those of this chunk

        def rows(lang: str, ids: list[int], starts: int) -> Iterator[pa.RecordBatch]:
            (k0, k1), n = _windows(np.array(ids, np.int64), starts)
            names = pa.array([None, *(w.decode() for w in local)], pa.string()) if spelt else None
            for i in range(0, len(n), 1 << 15):
                a, b, c = (x[i : i + (1 << 15)] for x in (k0, k1, n))
                columns = [names.take(pa.array(x)) for x in _unpacked(a, b)] if spelt else [pa.array(a), pa.array(b)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), *columns, pa.array(c, pa.int64())], [x.split()[0] for x in (_SPELT if spelt else _CODED).split(", ")])

        def told() -> Iterator[pa.RecordBatch]:
            for lang, ids in held.items():
                yield from rows(lang, ids, len(ids))
            held.clear()
            local.clear()

        size = 0
        for lang, data in _texts(batches):
            known = None if spelt else codes.get(lang, {})
            for piece in data.split(b"\n"):
                words = piece.split()
                if len(words) < 2:
                    continue
                long = len(words) > CHUNK
                if size + len(words) > CHUNK:
                    size = 0
                    yield from told()
                for i in range(0, len(words) if long else 1, CHUNK):
                    part = words[i : i + CHUNK + WORDS - 1] if long else words
                    ids = [local.setdefault(w, len(local) + 1) for w in part] if spelt else [known.get(w, 0) for w in part]
                    if long:
                        yield from rows(lang, ids, CHUNK)
                        local.clear()
                    else:
                        held.setdefault(lang, []).extend([*ids, 0])
                        size += len(words)
        yield from told()

    return _rows(docs).mapInArrow(run, _SPELT if spelt else _CODED)


def grow(columns: list[np.ndarray], n: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Frequent prefixes of sorted pointers: (a row that begins with it, its words, its count).

    columns: the languages and the WORDS words as numbers, 0 for none. Prefixes
    that hold the first or the last row may go on in other tasks, so they are
    told and extended whatever their count.
    """
    size, out = len(n), []
    upto = np.concatenate([[0], np.cumsum(n)])
    new, change = np.zeros(size, bool), []
    for c in columns:
        new = new | np.concatenate([[True], c[1:] != c[:-1]])
        change.append(new)
    stack = [(0, size, 0)]
    while stack:
        lo, hi, depth = stack.pop()  # the rows of one prefix of depth - 1 words
        starts = lo + np.flatnonzero(change[depth][lo:hi])
        if len(starts) == 0 or starts[0] != lo:
            starts = np.concatenate([[lo], starts])
        ends = np.append(starts[1:], hi)
        total = upto[ends] - upto[starts]
        kept = ((total >= least) | (starts == 0) | (ends == size)) & ((columns[depth][starts] > 0) | (depth == 0))
        for s, e, t in zip(starts[kept].tolist(), ends[kept].tolist(), total[kept].tolist()):
            if depth > 1:
                out.append((s, depth, t))
            if depth < WORDS:
                stack.append((s, e, depth + 1))
    return out


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, numbered: int = NUMBERED) -> DataFrame:
    """lang, phrase (words joined by a space), words, f of all phrases of 1 to WORDS words found least times or more."""
    table = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, numbers(words, least, min(numbered, (1 << _BITS) - 2))))
    spelt = table.value[1] is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = table.value[1]
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            if spelt:
                names = [batch.column(i).to_pylist() for i in range(1, 1 + WORDS)]
                columns = [batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for i in range(1, 1 + WORDS)]
            else:
                columns = _unpacked(batch.column(1).to_numpy(), batch.column(2).to_numpy())
            found = grow([langs.indices.to_numpy(), *columns], batch.column(3 if not spelt else 1 + WORDS).to_numpy(), least)
            lang = [langs[s].as_py() for s, _, _ in found]
            told = [" ".join([names[i][s] for i in range(d)] if spelt else [named[x][columns[i][s] - 1] for i in range(d)]) for x, (s, d, _) in zip(lang, found)]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(told, pa.string()), pa.array([d for _, d, _ in found], pa.int32()), pa.array([t for _, _, t in found], pa.int64())], ["lang", "phrase", "words", "f"])

    rows = pointers(docs, table)
    keys = [c for c in rows.columns if c != "n"]
    parts = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, phrase string, words int, f long")
    longer = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    one = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    return written(one.unionByName(longer).where(F.col("f") >= least), texts=True)


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every phrase of two words or more, at the cut that scores lowest (the first of equal ones).

    totals: lang and n. The score floor(1000 a n / (l r)) is computed in decimals of 38 digits.
    """
    several = phrases.where(F.col("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "words", "a", "x.l", "x.r", "n", "x.score")


def not_covered(found: DataFrame, covered: int = COVERED) -> DataFrame:
    """found without phrases inside a longer one that has covered per cent of their occurrences or more.

    One word more is enough to look at: whatever holds for a longer phrase
    holds for each between, which occurs at least as often.
    """
    last, first = F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")
    inner = found.where(F.col("words") > 2).select("lang", F.explode(F.array(last, first)).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    out = found.join(most, ["lang", "phrase"], "left")
    return out.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * covered)).drop("most")


def _ranked(found: DataFrame, told: int) -> DataFrame:
    """The first rows of every language; a part of a language is cut to its own first rows before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]

    def number(*by: str | Column) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(*order))

    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    parts = salted.withColumn("rank", number("lang", "salt")).where(F.col("rank") <= told)
    return parts.withColumn("rank", number("lang")).where(F.col("rank") <= told)


def collocations(docs: DataFrame, least: int = LEAST, told: int = TOLD, covered: int = COVERED, numbered: int = NUMBERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of every language the first told phrases by score, a, phrase.

    Texts: A-Z lowered, null ones empty, cut at . , ; : ! ? and line ends into
    pieces, those at spaces and tabs into words. Null languages are 'und', as
    rows of that name are. Every row counts, repeated ones too; other columns
    are ignored. Languages without a phrase found least times have no row, and
    an empty table gives none. Texts are read whole.
    """
    words = word_counts(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = written(scored(frequent_phrases(docs, words, least, numbered), totals))
    best = _ranked(not_covered(found, covered), told)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))
