"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled training rows; every word of
theirs is a term of the index. Document frequencies come from all documents.
A term's weight is (1 + log tf) * idf, times REST for words that the sample
does not tie to the toxic label (likelihood-ratio test): without that factor
the neighbours of a long text are those that share its subject. Beginnings of
words are terms where the test marks them, which meets inflected forms.

Postings are cut into blocks of example numbers with the block's largest
weight. A query adds up the bound of every block, scores the most promising
blocks, and then all blocks whose bound reaches the k-th best cosine so far,
so the neighbours are exact. Their votes, weighted by squared cosine, pass
through a logistic curve that is fitted to labelled rows outside the index.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_sample, cached, fold, rows_with, ship, small_batches, without, written

#: Bounds on what is learnt from: labelled rows; examples of the index, half of them toxic, and their characters; rows that fit the curve.
SAMPLE, EXAMPLES, CHARS, CALIBRATION = 16_000, 2_000, 16_000_000, 3_000
#: One labelled row of so many stays out of the index and fits the curve.
CURVE = 5
#: Least likelihood-ratio statistic and least toxic examples of a marked term.
G2, SUPPORT = 15.0, 3
#: Least share of the toxic rows with a marked term, over that of the others.
LIFT = 20
#: Factor of the weight of all other words.
REST = 0.1
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 8
BLOCK = 64
#: Blocks scored before the first k-th best cosine is known.
AHEAD = 4
#: Weight of the base rate, in neighbours of cosine 1.
PULL = 0.5
THRESHOLD = 0.3
EVIDENCE = 3
_WORD = re.compile(r"\w+")
_CHUNK = 8_192
_MEMO = 200_000


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def features(words: Counter) -> Counter:
    """Counts of words and of the beginnings (^...) of longer words."""
    out = Counter(words)
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                out["^" + w[:k]] += n
    return out


def term_key(term: str) -> int:
    """Terms are told apart by 64-bit hashes."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "replace")) - (1 << 63)


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pos: Counter = Counter()
    neg: Counter = Counter()

    def rows() -> pd.DataFrame:
        terms = list(pos.keys() | neg.keys())
        return pd.DataFrame({"term": pd.Series(terms, dtype=object), "pos": [pos[t] for t in terms], "neg": [neg[t] for t in terms]})

    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"]):
            (pos if toxic else neg).update(features(word_counts(text)).keys())
            if len(pos) + len(neg) > 200_000:
                yield rows()
                pos.clear(), neg.clear()
    yield rows()


def marked_terms(sample: DataFrame) -> list[str]:
    """sample: (text, toxic). All terms tied to toxic rows; as many as the bounded sample holds at most."""
    counts = sample.select("text", "toxic").mapInPandas(_term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    total = sample.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    p, n = total["p"] or 0, total["n"] or 0
    if not p or not n:
        return []

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b, whole = F.col("a"), F.col("b"), p + n
    stat = 2 * (part(a, (a + b) * p / whole) + part(b, (a + b) * n / whole) + part(p - a, (whole - a - b) * p / whole) + part(n - b, (whole - a - b) * n / whole))
    best = counts.where((a >= SUPPORT) & (a * n > LIFT * b * p)).where(F.round(stat, 6) >= G2)
    with small_batches(sample.sparkSession):
        return sorted(r["term"] for r in best.select("term").collect())


@dataclass
class Vocabulary:
    """Terms of the index: sorted keys of the words, and numbers of the marked terms."""

    keys: np.ndarray
    marked: frozenset[str]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _number(self, key: int) -> int:
        i = int(np.searchsorted(self.keys, key))
        return i if i < len(self.keys) and self.keys[i] == key else -1

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending numbers and counts of the terms of a whole text; words outside the vocabulary have none."""
        counts: dict[int, int] = {}
        words = word_counts(text)
        memo: dict[str, tuple[int, ...]] = cached(("toxicity", self.name), dict)
        new = [w for w in words if w not in memo]
        found = dict(zip(new, self._look_up(new))) if new else {}
        for w, n in words.items():
            for i in memo[w] if w in memo else found[w]:
                counts[i] = counts.get(i, 0) + n
        if len(memo) < _MEMO:
            memo.update((w, t) for w, t in found.items() if len(w) <= 64)
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        by = np.argsort(terms)
        return terms[by], np.fromiter(counts.values(), np.float64, len(counts))[by]

    def _look_up(self, words: list[str]) -> list[tuple[int, ...]]:
        """Numbers of the terms that each word stands for: itself and its marked beginnings."""
        if not len(self.keys):
            return [()] * len(words)
        keys = np.fromiter(map(term_key, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = np.where(self.keys[at] == keys, at, -1).tolist()
        begun = [tuple(self._number(term_key(b)) for k in BEGINNINGS if len(w) > k and (b := "^" + w[:k]) in self.marked) for w in words]
        return [(i, *t) if i >= 0 else t for i, t in zip(own, begun)]

    def factors(self) -> np.ndarray:
        out = np.full(len(self.keys), REST)
        for t in self.marked:
            if (i := self._number(term_key(t))) >= 0:
                out[i] = 1.0
        return out


def weigh(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    return w / math.sqrt(float((w * w).sum())) if len(w) else w


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0] .. end[0] - 1, start[1] .. end[1] - 1, ..."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@dataclass
class Index:
    """Examples by number, sorted so that like ones share a block.

    Postings lie by term, then example; a cell is the postings of one term in
    one block.
    """

    ids: list[int]
    toxic: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    cell_block: np.ndarray
    cell_max: np.ndarray
    cell_first: np.ndarray  # one more than cells
    term_first: np.ndarray  # first cell of each term, one more than terms
    idf: np.ndarray
    share: float  # of toxic examples
    empty: float  # score of a text without terms
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def build(cls, examples: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray, empty: float = 0.0) -> Index:
        """examples: (doc_id, toxic, terms, counts); idf: weights of the terms. Examples without terms are none."""
        rows = [(i, y, np.asarray(t, np.int64), weigh(np.asarray(t, np.int64), np.asarray(c, np.float64), idf)) for i, y, t, c in examples if len(t)]
        df = np.bincount(np.concatenate([r[2] for r in rows]), minlength=len(idf)) if rows else np.zeros(len(idf), np.int64)
        rows.sort(key=lambda r: (-r[1], r[2][np.argsort(-df[r[2]], kind="stable")[:4]].tolist(), r[0]))  # by the commonest terms: one language, one range of blocks
        term = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int64)
        example = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0)
        by = np.argsort(term, kind="stable")
        term, example, weight = term[by], example[by], weight[by]
        cell = term * (len(rows) // BLOCK + 1) + example // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        toxic = np.array([r[1] for r in rows], float)
        return cls(
            [r[0] for r in rows],
            toxic,
            example,
            weight,
            example[first] // BLOCK,
            np.maximum.reduceat(weight, first) if len(first) else np.zeros(0),
            np.append(first, len(cell)),
            np.searchsorted(term[first], np.arange(len(idf) + 1)),
            idf,
            float(toxic.mean()) if rows else 0.0,
            empty,
        )

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """(cosine, number) of the k nearest examples; ties by number. Examples without a common term are none."""
        if not len(terms) or not self.ids:
            return []
        q = weigh(terms, counts, self.idf)
        lo, hi = self.term_first[terms], self.term_first[terms + 1]
        cells = _spans(lo, hi)
        if not len(cells):
            return []
        own, blocks = np.repeat(q, hi - lo), self.cell_block[cells]
        bound = np.bincount(blocks, weights=own * self.cell_max[cells])
        order = np.argsort(-bound, kind="stable")

        def score(take: np.ndarray) -> list[tuple[float, int]]:
            wanted = np.zeros(len(bound), bool)
            wanted[take] = True
            some = wanted[blocks]
            a, b = self.cell_first[cells[some]], self.cell_first[cells[some] + 1]
            at = _spans(a, b)
            s = np.bincount(self.example[at], weights=np.repeat(own[some], b - a) * self.weight[at])
            hit = np.flatnonzero(s)
            if len(hit) > k:
                least = np.partition(s[hit], len(hit) - k)[len(hit) - k]
                hit = hit[s[hit] >= least]
            return [(-float(s[i]), int(i)) for i in hit]

        best = sorted(score(order[:AHEAD]))[:k]
        least = -best[-1][0] if len(best) == k else 0.0
        rest = order[AHEAD:]
        rest = rest[(bound[rest] > 0) & (bound[rest] >= least * (1 - 1e-12))]
        if len(rest):
            best = sorted(best + score(rest))[:k]
        return [(-s, i) for s, i in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = np.array([min(s, 1.0) ** 2 for s, _ in near])
        y = self.toxic[[i for _, i in near]]
        return (float((w * y).sum()) + PULL * self.share) / (float(w.sum()) + PULL)

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[dict]]:
        near = self.nearest(terms, counts)
        if not near:
            return self.empty, []
        a, b = self.curve
        value = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * logit(self.vote(near)) + b))))
        return round(value, 9), [{"doc_id": self.ids[i], "cosine": min(s, 1.0), "toxic": int(self.toxic[i])} for s, i in near[:EVIDENCE]]


def logit(v: float) -> float:
    v = min(max(v, 1e-4), 1 - 1e-4)
    return math.log(v / (1 - v))


def fit_curve(votes: np.ndarray, toxic: np.ndarray, start: tuple[float, float]) -> tuple[float, float]:
    """Slope and offset of the logistic curve from logit of the vote to the label, drawn to start by a unit ridge."""
    x, y, at = np.array([logit(v) for v in votes]), np.asarray(toxic, float), np.array(start)

    def loss(p: np.ndarray) -> float:
        z = p[0] * x + p[1]
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * ((p - start) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -40, 40)))
        g = np.array([((p - y) * x).sum(), (p - y).sum()]) + (at - start)
        h = p * (1 - p)
        step = np.linalg.solve(np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]]), g)
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return max(float(at[0]), 0.0), float(at[1])


def choose_examples(rows: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """rows: (doc_id, toxic, characters) in the sample's order -> ids of the index's examples, and of the curve's rows.

    Each fifth row fits the curve; toxic rows take up to half of EXAMPLES, and
    rows are passed over where CHARS would be exceeded.
    """
    curve = [i for i, _, _ in rows[::CURVE]][:CALIBRATION]
    rest, chosen = [r for n, r in enumerate(rows) if n % CURVE], []
    toxic = sum(y for _, y, _ in rest)
    room = {1: max(EXAMPLES // 2, EXAMPLES - (len(rest) - toxic)), 0: EXAMPLES - min(toxic, EXAMPLES // 2)}
    chars = {0: 0, 1: 0}
    for i, y, n in rest:
        if room[y] and chars[y] + n <= CHARS // 2:
            room[y], chars[y] = room[y] - 1, chars[y] + n
            chosen.append(i)
    return chosen, curve


def vectors(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(doc_id, terms, counts): numbers and counts of the terms of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.of(t.as_py()) for t in b.column("text")]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32) if found else [], pa.int32())) for x in ([t for t, _ in found], [c for _, c in found])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], ["doc_id", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, terms array<int>, counts array<int>")


def _counted(rows: DataFrame, words: Vocabulary, column: str) -> tuple[int, np.ndarray]:
    """Rows of a table of vectors (column terms) or of texts (column text), and in how many of them each term occurs; what is collected has the size of the vocabulary."""
    size = len(words.keys)
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def terms(b: pa.RecordBatch) -> np.ndarray:
        if column == "terms":
            return b.column(0).flatten().to_numpy(zero_copy_only=False)
        return np.concatenate([sent.value.of(t.as_py())[0] for t in b.column(0)] or [np.zeros(0, np.int64)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)
        for b in batches:
            n[size] += len(b)
            n[:size] += np.bincount(terms(b), minlength=size)
        at = range(0, size + 1, _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([n[i : i + _CHUNK].astype(np.uint32).tobytes() for i in at], pa.binary())], ["chunk", "n"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b["chunk"], b["n"]):
                x = np.frombuffer(x, np.uint32).astype(np.int64)
                sums[c] = sums[c] + x if c in sums else x
        yield pd.DataFrame({"chunk": list(sums), "n": pd.Series([x.tobytes() for x in sums.values()], dtype=object)}).astype({"chunk": "int64"})

    parts = rows.select(column).mapInArrow(count, "chunk long, n binary").repartition("chunk").mapInPandas(add, "chunk long, n binary")
    out = np.zeros(size + 1, np.int64)
    with small_batches(rows.sparkSession):
        for r in parts.collect():
            x = np.frombuffer(r["n"], np.int64)
            out[r["chunk"] : r["chunk"] + len(x)] = x
    return int(out[size]), out[:size]


def fitted(docs: DataFrame, labels: DataFrame, keep: bool = False) -> tuple[Vocabulary, Index, DataFrame]:
    """Vocabulary and index learnt from the labelled rows that aren't held out; with keep, a written table of the vectors of docs, too."""
    spark = docs.sparkSession
    train = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), 4) != 2).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = written(bounded_sample(train, "id", SAMPLE))
    # of a repeated doc_id the text with the smallest hash is the example
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "id")  # at most SAMPLE rows of two numbers
    texts = found.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "toxic", F.col("t.text").alias("text"))
    texts = written(texts.withColumn("n", F.length("text")).withColumn("bare", ~F.col("text").rlike(r"(?U)\w")))
    rows = [tuple(r) for r in texts.orderBy(F.xxhash64("id"), "id").select("id", "toxic", "n", "bare").collect()]  # at most SAMPLE rows of four values
    chosen, curve = choose_examples([r[:3] for r in rows])
    role = spark.createDataFrame([(i, 0) for i in chosen] + [(i, 1) for i in curve], "id long, role int")
    texts = texts.join(F.broadcast(role), "id", "left").select("id", "toxic", "text", "role")
    prior = sum(r[1] for r in rows) / len(rows) if rows else 0.0
    bare = [r[1] for r in rows if r[3]]
    empty = (sum(bare) + PULL * prior) / (len(bare) + PULL)

    marked = marked_terms(texts.where("role is null or role = 0"))
    with small_batches(spark):
        own = texts.where("role = 0").select("id", "toxic", "text").orderBy("id").collect()  # at most EXAMPLES rows and CHARS characters
    keys = {term_key(t) for t in marked}.union(*(map(term_key, word_counts(r["text"])) for r in own))
    words = Vocabulary(np.array(sorted(keys), np.int64), frozenset(marked))
    every = written(vectors(docs, words), texts=True) if keep else docs
    with small_batches(spark):
        n, df = _counted(every, words, "terms" if keep else "text")
    idf = (np.log((1 + n) / (1 + df)) + 1) * words.factors()
    examples = [(r["id"], r["toxic"], *words.of(r["text"])) for r in own]
    index = Index.build(examples, idf, empty)
    sent, vocabulary = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(words)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = [sent.value.nearest(*vocabulary.value.of(t)) for t in b["text"]]
            f = pd.DataFrame({"toxic": b["toxic"], "vote": [sent.value.vote(x) if x else None for x in near]})
            yield f[f["vote"].notna()]

    with small_batches(spark):
        got = texts.where("role = 1").select("text", "toxic").mapInPandas(votes, "toxic int, vote double").collect()  # at most CALIBRATION rows
    index.curve = fit_curve(np.array([r["vote"] for r in got]), np.array([r["toxic"] for r in got]), (1.0, logit(prior) - logit(index.share)))
    return words, index, every


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, evidence.

    evidence: the nearest examples (doc_id, cosine, toxic), empty for texts
    without a term of the index (null and empty ones too), which score the
    smoothed rate of labelled texts without words. Learns from rows of labels
    that are not held out and whose doc_id and toxic aren't null; several
    labels of a document count as toxic if one is; of a labelled doc_id with
    several texts, the one with the smallest hash is the example. Without such
    rows every score is 0. A score depends on the text alone, so each row of a
    repeated doc_id is scored by its own; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    _, fit, rows = fitted(docs, labels, keep=True)
    index = spark.sparkContext.broadcast(fit)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, counts = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
            ends = np.cumsum(b.column("terms").value_lengths().to_numpy(zero_copy_only=False)).tolist()
            out = [index.value.score(terms[x:y], counts[x:y]) for x, y in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], kind)], ["doc_id", "score", "evidence"])

    scored = rows.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is predicted toxic, null and repeated doc_ids alike; all columns stay."""
    spark = docs.sparkSession
    ship(spark)
    words, index = (spark.sparkContext.broadcast(x) for x in fitted(docs, labels)[:2])
    return without(docs, rows_with(docs, lambda t: index.value.score(*words.value.of(t))[0] >= THRESHOLD))
