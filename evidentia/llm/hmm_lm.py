"""Hidden Markov language model: distributed Baum-Welch, exact scaled forward scores.

The CLASSES most frequent words are symbols of their own; all other words
share one symbol, inside which a word has its unigram probability, so the
model is a distribution over all words and the likelihood of a text is exact.
Each Baum-Welch round sends the parameters out, adds up expected counts in
every partition and brings back sums of fixed size. Word counts, and the
unigram part of rare words, are joined and added up over the whole corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_sample, fold_py, ship, words_of, written

STATES = 6
CLASSES = 60_000
#: Bytes of a word that may be a symbol of its own.
LONGEST = 256
#: Rounds over the bounded sample that seeds the model, and over all training texts.
SEED_ROUNDS, ROUNDS = 12, 2
#: Texts of that sample, and their tokens; texts that would exceed the tokens are passed over.
SEED_DOCS, SEED_TOKENS = 1_500, 1_500_000
#: Pseudo-tokens of unigram text that each state has seen.
SMOOTH = 100.0
STICK = 0.95
FOLDS, HELD = 7, 2
END = b" "
_GROUP = 400_000
_CHUNK = 8_192


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (symbols, K)


def packed(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of like length, all their first tokens first, then the second ones, and so on.

    Yields numbers of the texts by falling length, symbols, each symbol's text
    (position in those numbers), and the first row of every step.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    at = 0
    while at < len(order):
        to, size = at, 0
        while to < len(order) and (to == at or size + len(docs[order[to]]) <= _GROUP):
            size += len(docs[order[to]])
            to += 1
        own = np.array(order[at:to])
        lens = np.array([len(docs[i]) for i in own])
        text = np.repeat(np.arange(len(own)), lens)
        step = np.arange(size) - np.repeat(np.cumsum(lens) - lens, lens)
        by = np.argsort(step, kind="stable")
        yield own, np.concatenate([docs[i] for i in own])[by].astype(np.int64), text[by], np.searchsorted(step[by], np.arange(lens[0] + 1))
        at = to


def forward(model: Model, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled state probabilities, the scales, and the emissions of a packed group."""
    e = model.emit[symbols]
    a, c = np.empty_like(e), np.empty(len(e), e.dtype)
    bounds = first.tolist()
    for t in range(len(bounds) - 1):
        lo, hi = bounds[t], bounds[t + 1]
        now = a[lo:hi]
        np.multiply(model.start if t == 0 else a[bounds[t - 1] : bounds[t - 1] + hi - lo] @ model.move, e[lo:hi], out=now)
        s = now.sum(axis=1)
        c[lo:hi] = s
        now /= s[:, None]
    return a, c, e


def log10_likelihood(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(docs))
    short = [i for i, d in enumerate(docs) if len(d) <= _GROUP]
    for own, symbols, text, first in packed([docs[i] for i in short]):
        _, c, _ = forward(model, symbols, first)
        out[np.array(short)[own]] = np.bincount(text, weights=np.log10(c), minlength=len(own))
    for i in set(range(len(docs))).difference(short):
        out[i] = _log10_of_long(model, docs[i])
    return out


def _log10_of_long(model: Model, symbols: np.ndarray) -> float:
    """The same recursion slice by slice, so that a text of any length needs the memory of one slice."""
    total, start = 0.0, model.start
    for at in range(0, len(symbols), _GROUP):
        part = symbols[at : at + _GROUP].astype(np.int64)
        a, c, _ = forward(Model(start, model.move, model.emit), part, np.arange(len(part) + 1))
        total += float(np.log10(c).sum())
        start = a[-1] @ model.move
    return total


def expected_counts(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch sums over texts: first states, moves, emissions."""
    k = len(model.start)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
    for _, symbols, _, first in packed(docs):
        a, c, e = forward(model, symbols, first)
        b = np.ones_like(e)
        e /= c[:, None]
        bounds = first.tolist()
        back = np.ascontiguousarray(model.move.T)
        for t in range(len(bounds) - 3, -1, -1):
            lo, n = bounds[t], bounds[t + 2] - bounds[t + 1]
            nxt = bounds[t + 1]
            np.multiply(b[nxt : nxt + n], e[nxt : nxt + n], out=e[nxt : nxt + n])  # from here on e holds emission * beta / scale
            np.matmul(e[nxt : nxt + n], back, out=b[lo : lo + n])
        n0 = bounds[1]
        later = np.arange(n0, len(symbols))
        if len(later):
            step = np.searchsorted(first, later, side="right") - 1
            before = first[step - 1] + later - first[step]
            moves += model.move * (a[before].T.astype(np.float64) @ e[n0:].astype(np.float64))
        g = a * b
        starts += g[:n0].sum(axis=0, dtype=np.float64)
        for s in range(k):
            emits[:, s] += np.bincount(symbols, weights=g[:, s], minlength=len(emits))
    return starts, moves, emits


def maximise(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, base: np.ndarray) -> Model:
    """base: unigram probabilities of the symbols, the pseudo-text of every state."""
    k = len(starts)
    emit = emits + SMOOTH * base[:, None]
    sticky = moves + 1.0 + (k * 9.0) * np.eye(k)
    return Model((starts + 1) / (starts.sum() + k), sticky / sticky.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def seeded(docs: list[np.ndarray], base: np.ndarray, states: int = STATES, rounds: int = SEED_ROUNDS) -> Model:
    """A first model from a bounded list of texts; random but the same in every run."""
    rng = np.random.default_rng(20)
    emit = base[:, None] * np.exp(0.5 * rng.standard_normal((len(base), states)))
    move = np.full((states, states), (1 - STICK) / max(1, states - 1))
    np.fill_diagonal(move, STICK if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    for _ in range(rounds if docs else 0):
        model = maximise(*expected_counts(model, docs), base)
    return model


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values())})

    for b in batches:
        for d, t in zip(b["doc_id"].astype("Int64"), b["text"]):
            if fold_py(None if d is pd.NA else int(d), FOLDS) != HELD:
                seen.update(words_of(t))
                seen[END] += 1
                if len(seen) > 250_000:
                    yield rows()
                    seen.clear()
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): UTF-8 words and the end token of the training texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame) -> list[Row]:
    """The CLASSES most frequent rows of counts (word, c), ties by hash; all of them if there are no more.

    A level is a sixteenth of a power of two, so a histogram of a few hundred
    rows decides which levels fit as a whole; only the next one is ordered, and
    no partition sends more than its share of the result.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    counts = counts.where(F.length("word") <= LONGEST)
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, part = 0, None
    for at, n in sizes:
        if held + n > CLASSES:
            part = at
            break
        held += n
    whole = counts if part is None else counts.where(level > part)
    rows = whole.collect() if held else []
    if part is not None:
        rows += counts.where(level == part).orderBy(F.desc("c"), F.xxhash64("word"), "word").limit(CLASSES - held).collect()
    return sorted(rows, key=lambda r: (-r["c"], bytes(r["word"])))


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score and base_score are log10 probabilities of the whole text and its end
    under the HMM and the add-one unigram model. Null and empty texts are the
    end alone; a null doc_id belongs to the fold of the empty text. Repeated
    rows each have a row and each count. Without training rows nothing is
    known, and both scores are 0 log10 per token. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = written(word_counts(texts), texts=True)
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    top = frequent_words(counts)
    total = n + v + 1
    base = np.array([(r["c"] + 1) / total for r in top] + [0.0])
    base[-1] = max(1.0 - base.sum(), 0.0) or 1.0 / total
    base /= base.sum()
    number = spark.sparkContext.broadcast({bytes(r["word"]): (i, float(np.log10((r["c"] + 1) / total))) for i, r in enumerate(top)})
    rare_symbol = len(top)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = number.value
        get = known.get
        none = (rare_symbol, 0.0)
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                w = words_of(t)
                w.append(END)
                pairs = [get(x, none) for x in w]
                ids = np.fromiter((p[0] for p in pairs), np.uint16, len(w))
                rare = Counter(x for x, p in zip(w, pairs) if p is none)
                k = int(sum(rare.values()))
                out.append((d, fold_py(None if d is pd.NA else int(d), FOLDS) == HELD, len(w), len(w) - k, sum(p[1] for p in pairs), ids.tobytes(), list(rare), list(rare.values())))
            f = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_top", "top", "ids", "rare", "times"], dtype=object)
            yield f.astype({"doc_id": "Int64", "held_out": bool, "n_tokens": "int64", "n_top": "int64", "top": "float64"})

    rows = texts.mapInPandas(encode, "doc_id long, held_out boolean, n_tokens long, n_top long, top double, ids binary, rare array<binary>, times array<long>")
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), texts=True)

    # the unigram part of the words without a symbol of their own: those seen in training by a join, the rest as unseen
    flat = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    seen = flat.join(counts, "word").groupBy("rid").agg(F.sum("times").alias("n_seen"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain"))

    model = _train(rows, base)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ll = log10_likelihood(sent.value, [np.frombuffer(x, np.uint16) for x in b["ids"]])
            yield pd.DataFrame({"rid": b["rid"], "doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "n_tokens": b["n_tokens"], "n_top": b["n_top"], "top": b["top"], "ll": ll})

    scored = rows.select("rid", "doc_id", "held_out", "n_tokens", "n_top", "top", "ids").mapInPandas(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_top long, top double, ll double")
    unseen = float(-np.log10(total))
    n_rare = F.col("n_tokens") - F.col("n_top")
    rare_score = n_rare * F.lit(unseen) + F.coalesce("gain", F.lit(0.0))
    return scored.join(seen, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_seen", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("top") + rare_score).alias("base_score"),
        (F.col("ll") + rare_score - n_rare * F.lit(float(np.log10(base[-1])))).alias("score"),
    )


def _train(rows: DataFrame, base: np.ndarray) -> Model:
    """rows: (held_out, ids), encoded texts."""
    spark = rows.sparkSession
    train = rows.where("not held_out")
    chosen, room = [], SEED_TOKENS
    for r in bounded_sample(train.select("rid", "n_tokens"), "rid", SEED_DOCS).collect():
        if r["n_tokens"] <= room:
            chosen.append((r["rid"],))
            room -= r["n_tokens"]
    picked = F.broadcast(spark.createDataFrame(chosen, "rid long"))  # at most SEED_DOCS numbers
    some = train.join(picked, "rid").select("ids").collect()  # at most SEED_DOCS texts and SEED_TOKENS tokens
    model = seeded([np.frombuffer(r["ids"], np.uint16) for r in some], base)
    k, symbols = len(model.start), len(base)
    for _ in range(ROUNDS if some else 0):
        sent = spark.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit))))

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            sums = np.zeros(k + k * k + symbols * k)
            for b in batches:
                parts = [ids[i : i + _GROUP] for x in b["ids"] for ids in [np.frombuffer(x, np.uint16)] for i in range(0, len(ids), _GROUP)]  # very long texts train in parts
                sums += np.concatenate([x.ravel() for x in expected_counts(sent.value, parts)])
            at = range(0, len(sums), _CHUNK)
            yield pd.DataFrame({"chunk": list(range(len(at))), "sums": pd.Series([sums[i : i + _CHUNK].tobytes() for i in at], dtype=object)})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for c, x in zip(b["chunk"], b["sums"]):
                    x = np.frombuffer(x)
                    sums[c] = sums[c] + x if c in sums else x
            yield pd.DataFrame({"chunk": list(sums), "sums": pd.Series([x.tobytes() for x in sums.values()], dtype=object)}).astype({"chunk": "int64"})

        parts = train.select("ids").mapInPandas(expect, "chunk long, sums binary").repartition("chunk").mapInPandas(add, "chunk long, sums binary").collect()  # the size of the model
        sums = np.zeros(k + k * k + symbols * k)
        for r in parts:
            x = np.frombuffer(r["sums"])
            sums[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(x)] += x
        sent.unpersist()
        model = maximise(sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k :].reshape(symbols, k), base)
    return model
