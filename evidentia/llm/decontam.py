"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are the query set; documents are scanned where they lie, twice
and without a shuffle of texts. The first scan counts in how many documents
each word pair of an item occurs. The seeds of an item are its rarest pairs:
an alignment worth THRESHOLD of an item of L words leaves at least L / 3 - 1
neighbouring pairs unedited (each edit costs a point and breaks one run), so
the commonest L / 3 - 2 pairs can be left out and a seed still remains, however
densely a copy is edited. The second scan looks seeds up; where enough pairs
of the item lie around a seed, item and surroundings are aligned word by word.

Words are numbers in the items' vocabulary. Items come in blocks of BLOCK_CHARS
characters, each with scans of its own, so what is sent to the executors is bounded whatever
the size of the benchmark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import rows_with, ship, small_batches, without, written

#: Items of a block, and characters of its items; an item above that is a block of its own.
BLOCK, BLOCK_CHARS = 200_000, 8_000_000
MATCH, MISMATCH, GAP = 2, -1, -2
#: Least alignment score, as a share of the item's own.
THRESHOLD = 0.5
#: An alignment worth so many equal words is a copied passage, however long its item.
PASSAGE = 50
#: Items of fewer words must occur as a whole.
WHOLE = 4
#: Words of a stretch of an item, out of each of which seeds are chosen.
STRETCH = 48
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def numbered(w: list[str], number: dict[str, int]) -> np.ndarray:
    """Numbers of words; 0 for words that no item has."""
    get = number.get
    return np.array([get(x, 0) for x in w], np.int64)


def pairs(code: np.ndarray, words_known: int) -> np.ndarray:
    """A number for every two neighbouring words, 0 where one of them is unknown."""
    a, b = code[:-1], code[1:]
    return np.where((a > 0) & (b > 0), a * (words_known + 1) + b, 0)


def kept_pairs(n: int) -> int:
    """Neighbouring pairs that any alignment worth THRESHOLD of n words leaves unedited."""
    return max(-(-n // 3) - 1, 0)


def grams(item: np.ndarray, words_known: int) -> np.ndarray:
    """The pairs of an item; the word itself of an item of one word."""
    return item if len(item) == 1 else pairs(item, words_known)


def choose_seeds(own: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Positions of the seeds among an item's grams: in each stretch all but the commonest that can be left out."""
    out = []
    for at in range(0, len(own), STRETCH):
        n = min(STRETCH, len(own) - at)
        if at and n < STRETCH // 2:  # a short end joins the stretch before
            at, n = at - STRETCH, n + STRETCH
            out.pop()
        spare = max(kept_pairs(min(n, STRETCH) + 1) - 1, 0)
        out.append(at + np.argsort(df[at : at + n], kind="stable")[: n - spare])
    return np.sort(np.concatenate(out))


@dataclass
class Block:
    """Items of a block with their seeds, as sorted numbers and the places they stand for."""

    number: dict[str, int]  # of every word of the items, from 1 on
    ids: list[int]
    items: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray  # first place of each key, one more than keys
    item: np.ndarray
    at: np.ndarray
    single: bool  # whether some item has one word

    @classmethod
    def build(cls, number: dict[str, int], ids: list[int], items: list[np.ndarray], gram_keys: np.ndarray, df: np.ndarray) -> Block:
        """gram_keys, df: all grams in order, and documents with them."""
        rows = []
        for i, w in enumerate(items):
            own = grams(w, len(number))
            for k in choose_seeds(own, df[np.searchsorted(gram_keys, own)]):
                rows.append((int(own[k]), i, int(k)))
        rows.sort()
        h = np.array([r[0] for r in rows], np.int64)
        keys, first = np.unique(h, return_index=True)
        return cls(number, ids, items, keys, np.append(first, len(h)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), any(len(w) == 1 for w in items))


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h of the values that keys has, and their places in keys."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == h)
    return hit, at[hit]


def _last_row_best(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the ends (exclusive) in item and doc of the first such alignment."""
    ramp = -GAP * np.arange(len(doc) + 1)
    h, best = np.zeros(len(doc) + 1, np.int64), (0, 0, 0)
    for i, w in enumerate(item):
        step = np.where(doc == w, MATCH, MISMATCH)
        t = np.maximum(h + GAP, 0)
        t[1:] = np.maximum(t[1:], h[:-1] + step)
        t[0] = 0
        h = np.maximum.accumulate(t + ramp) - ramp  # gaps along doc
        j = int(h.argmax())
        if h[j] > best[0]:
            best = int(h[j]), i + 1, j
    return best


def align(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: score as a share of the item's own, start and end in doc."""
    score, i, j = _last_row_best(item, doc)
    if not score:
        return 0.0, 0, 0
    _, _, back = _last_row_best(item[:i][::-1], doc[:j][::-1])
    return score / (MATCH * len(item)), j - back, j


def _regions(starts: np.ndarray, n: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text of size words around the places where an item of n words would start, as far as gaps can move it."""
    pad = n // 2 + 2
    lo = hi = None
    for s in np.unique(starts).tolist():
        if hi is not None and s - pad > hi:
            yield max(0, lo), min(size, hi)
            lo = None
        lo, hi = (s - pad if lo is None else lo), s + n + pad
    if lo is not None:
        yield max(0, lo), min(size, hi)


def find_in(text: str | None, block: Block, first_only: bool = False) -> list[tuple[int, float, int, int, int]]:
    """(item, score, first and last code point, seeds met) of the best alignment of each item that the text's seeds point to."""
    code = numbered(words(text), block.number)
    own_pairs = pairs(code, len(block.number))
    met, key = _found(block.keys, own_pairs)
    if block.single:
        one, k1 = _found(block.keys, code)
        met, key = np.append(met, one), np.append(key, k1)
    if not len(met):
        return []
    n = block.first[key + 1] - block.first[key]
    place = np.repeat(block.first[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    item, start = block.item[place], np.repeat(met, n) - block.at[place]
    out, places = [], None
    for i in np.unique(item).tolist():
        own = block.items[i]
        starts = start[item == i]
        need = 1 if len(own) < WHOLE else max(1, min(kept_pairs(len(own)), kept_pairs(PASSAGE)))
        best = (0.0, 0, 0)
        for lo, hi in _regions(starts, len(own), len(code)):
            if len(own) > 1 and int(np.isin(pairs(own, len(block.number)), own_pairs[lo : max(lo, hi - 1)]).sum()) < need:
                continue
            score, a, b = align(own, code[lo:hi])
            if score > best[0]:
                best = score, lo + a, lo + b
        if best[0] >= (THRESHOLD if len(own) >= WHOLE else 1.0) or best[0] * len(own) >= PASSAGE - 1e-6:
            places = places or [m.span() for m in _WORD.finditer(text.lower())]
            out.append((i, best[0], places[best[1]][0], places[best[2] - 1][1], len(starts)))
            if first_only:
                break
    return out


def blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks with seeds chosen by their number of documents."""
    known = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    known = written(known.withColumn("item", F.xxhash64("item_id", "text")))  # blocks are ranges of it
    after = None
    while True:
        more = known if after is None else known.where(F.col("item") > after)
        sizes = more.select("item", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy("item").limit(BLOCK).collect()
        if not sizes:
            return
        fit = max(1, bisect_right(list(accumulate(r["n"] for r in sizes)), BLOCK_CHARS))
        last = sizes[:fit][-1]["item"]
        rows = sorted((r["item"], r["item_id"], r["text"]) for r in more.where(F.col("item") <= last).where("text is not null").collect())
        items = [(i, w) for _, i, t in rows if (w := words(t))]
        if items:
            yield _seeded(docs, [i for i, _ in items], [w for _, w in items])
        if fit >= len(sizes) and len(sizes) < BLOCK:
            return
        after = last


def _seeded(docs: DataFrame, ids: list[int], texts: list[list[str]]) -> Block:
    """texts: the words of each item."""
    number = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}), 1)}
    items = [numbered(t, number) for t in texts]
    keys = np.unique(np.concatenate([grams(w, len(number)) for w in items]))
    single = any(len(w) == 1 for w in items)
    sent = docs.sparkSession.sparkContext.broadcast((number, keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys = sent.value
        n = np.zeros(len(keys), np.int64)
        for b in batches:
            for t in b.column("text"):
                code = numbered(words(t.as_py()), number)
                both = pairs(code, len(number))
                n[np.unique(_found(keys, np.append(both, code) if single else both)[1])] += 1
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], ["gram", "n"])

    counts = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        got = counts.toArrow()  # two numbers for a gram of the block at most
    df = np.zeros(len(keys), np.int64)
    df[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return Block.build(number, ids, items, keys, df)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, start, end, seeds.

    score: the best local alignment's, as a share of aligning the item with
    itself: at least THRESHOLD, or less where the alignment is worth PASSAGE
    equal words; items of fewer than WHOLE words must occur whole. start, end:
    code points of the lower-cased text. Clean documents have no row. Null and
    empty texts, items without words and null item_ids match nothing; every
    distinct text of a repeated item_id is an item of its own; repeated rows of
    docs have a row each, null doc_ids too. Other columns are ignored, and
    empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, start long, end long, seeds long"
    out = None
    for block in blocks(texts, benchmark):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(d, sent.value.ids[i], *x) for d, t in zip(b["doc_id"].astype("Int64"), b["text"]) for i, *x in find_in(t, sent.value)]
                found = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start", "end", "seeds"], dtype=object)
                yield found.astype({"doc_id": "Int64", "item_id": "int64", "score": "float64", "start": "int64", "end": "int64", "seeds": "int64"})

        found = texts.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a test item, null and repeated doc_ids alike; all columns stay."""
    spark = docs.sparkSession
    ship(spark)
    found = []
    for block in blocks(docs, benchmark):
        sent = spark.sparkContext.broadcast(block)
        found.append(rows_with(docs, lambda t, sent=sent: bool(find_in(t, sent.value, first_only=True))))
    return without(docs, *([reduce(DataFrame.unionByName, found)] if found else []))
