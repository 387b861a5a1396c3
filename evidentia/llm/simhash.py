"""SimHash near-duplicates with a pigeonring filter.

A fingerprint is a 64-bit majority vote over the XXH64 hashes of a text's
3-word shingles. Two fingerprints link when at most TAU bits differ. The ring
has TAU + 1 segments; for a pair within TAU there is a start whose chains of
1, 2, ... consecutive segments differ by at most l * TAU / m bits in total
(Qin & Xiao's strong form of the pigeonhole principle). The first link of the
chain has budget 0, so it is an equality and serves as join key; the longer
chains are checked on the joined row before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ship, words_of, written
from evidentia.llm.components import components, hot_join

TAU = 2
SHINGLE = 3
SEED = 42
#: (first bit, width) of the ring's segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: A segment value shared by more distinct fingerprints than this is joined by one-bit neighbourhoods, which is linear in their number.
DENSE = 64


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash; a text without words has 0."""
    w = words_of(text)
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(w, w[1:], w[2:]))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # whole texts, in bounded memory
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        f = np.fromiter((fingerprint(t) for t in b["text"]), np.uint64, len(b)).view(np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": f})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits. Null texts count as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_fingerprints, "doc_id long, fp long")


def _segment(fp, first: int, width: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _chain(x, start: int):
    """Cumulative budgets of the chains that begin at a segment; x is the XOR of two fingerprints."""
    m, diff, ok = len(SEGMENTS), F.lit(0), F.lit(True)
    for length in range(1, m + 1):
        first, width = SEGMENTS[(start + length - 1) % m]
        diff = diff + F.bit_count(_segment(x, first, width))
        ok = ok & (diff <= F.lit(length * TAU // m))
    return ok


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of node ids that connect everything within TAU bits.

    nodes: (node, fp), one row per distinct fingerprint. Each pair within TAU
    is either linked itself or joined through a shared one-bit neighbour.
    """
    segs = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), *s).alias("val")) for i, s in enumerate(SEGMENTS)])).alias("s")).select("node", "fp", "s.*")
    sizes = segs.groupBy("seg", "val").agg(F.count("*").alias("n")).where("n > 1")
    segs = written(hot_join(segs, sizes, ["seg", "val"], F.col("n"), len(SEGMENTS) * nodes.count()))
    cold, dense = segs.where(F.col("n") <= DENSE), segs.where(F.col("n") > DENSE)

    x = F.col("p.fp").bitwiseXOR(F.col("q.fp"))
    ring = F.lit(False)
    for i in range(len(SEGMENTS)):
        ring = ring | ((F.col("p.seg") == i) & _chain(x, i))
    near = (
        cold.alias("p")
        .join(cold.alias("q"), (F.col("p.seg") == F.col("q.seg")) & (F.col("p.val") == F.col("q.val")) & (F.col("p.node") < F.col("q.node")) & ring & (F.bit_count(x) <= TAU))
        .select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    )
    # Within 2 bits and equal in a segment: both are within one flip, outside that segment, of a common value.
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long") for v in (1 << i for i in range(64))])
    inside = F.lit(False)
    for i, (first, width) in enumerate(SEGMENTS):
        mask = ((1 << width) - 1) << first
        inside = inside | ((F.col("seg") == i) & (F.col("flip").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")) != 0))
    hub = dense.select("node", "fp", "seg", F.explode(flips).alias("flip")).where(~inside).select("node", "seg", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    low = hub.groupBy("seg", "key").agg(F.min("node").alias("a"), F.count("*").alias("k")).where("k > 1").select("seg", "key", "a")
    far = hub.join(low, ["seg", "key"]).where("a <> node").select("a", F.col("node").alias("b"))
    return near.unionByName(far)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over links, itself included.
    Null and empty texts have fingerprint 0, which links like any other.
    Links are between fingerprints: rows of one doc_id with different texts
    each belong to the component of their own text, and a row without doc_id
    connects others and has their component_id; a component of null ids only
    has a null one. An empty table gives an empty result. Other columns of
    docs are ignored.
    """
    prints = written(fingerprints(docs), texts=True)
    # rows with equal fingerprints need no pairs: the fingerprint is the node
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    size, rows = classes.agg(F.count("*"), F.sum("n")).first()
    linked = components(links(classes.select(F.col("fp").alias("node"), "fp")))
    named = written(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    named = hot_join(named.select("fp", "n", "component"), smallest, ["component"], F.col("k"), size).select("fp", "n", "component_id")
    return hot_join(prints, named, ["fp"], F.col("n"), rows or 0).select("doc_id", "fp", "component_id")


def hexed(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
