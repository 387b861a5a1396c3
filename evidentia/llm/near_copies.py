"""SimHash near-dedup as the pipeline's stage needs it: Jaccard similarity over 5-word shingles.

Texts whose sets of 5-word shingles have a Jaccard similarity of at least
SIMILARITY link. Candidates come from two sides. SimHash fingerprints of those
shingles within TAU bits, by the pigeonring filter, give the copies and nearly
all edited ones. Pairs down to 0.8 differ in up to 11 bits, too far for a ring:
its segments would have 5 bits, which all texts share. These share a band of
ROWS min-hashes out of BANDS, but for one pair at 0.8 in 300,000. Every
candidate is verified on its shingles, so no link is wrong.

Members of a band are first compared to the band's smallest member only, so
that a large group of copies costs as many comparisons as it has members.
Members that remain in different components meet by an exact prefix filter,
not pair by pair: with the shingles of each in one order, the rarest first,
two sets that are similar enough share a shingle among the first fifth of
both, at places and with sizes that leave room for the overlap. What a crowd
shares is frequent, so it stands behind these; where edits are too few for
that, one text stands for the crowd and the others meet by their differences
to it (prefix_pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cached, row_key, ship, words_of, written
from evidentia.llm.components import SALTS, components, hot_join
from evidentia.llm.simhash import links, majority

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: SIMILARITY as a fraction.
OF = (4, 5)
BANDS, ROWS = 24, 4
#: Rows that meet pair by pair in a shingle with any number of others, and how often those of a larger crowd are split.
CROWD, LEVELS = 64, 6
_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> set[bytes]:
    """Distinct 5-word shingles; a shorter text is one shingle, a text without words has none."""
    w = words_of(text)
    if len(w) < SHINGLE:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))))


def similar(x: set[bytes], y: set[bytes]) -> bool:
    both = len(x & y)
    return both >= SIMILARITY * (len(x) + len(y) - both)


def hashes(grams: set[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))


def bands(h: np.ndarray) -> list[int]:
    """A signed 64-bit key of every band of hashed shingles; none for no shingles."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1 << 10):
        low = np.minimum(low, (h[at : at + (1 << 10), None] * _MUL + _ADD).min(axis=0))
    return [xxhash.xxh64_intdigest(r.tobytes(), n) - (1 << 63) for n, r in enumerate(low.reshape(BANDS, ROWS))]


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cached("near_copies", dict)  # nothing is kept, nor what other operators have left
    for b in batches:
        node = [xxhash.xxh64_intdigest(b" ".join(words_of(t)), SEED) - (1 << 63) for t in b["text"]]
        grams = [hashes(shingles(t)) for t in b["text"]]
        prints = np.array([majority(h) for h in grams], np.uint64).view(np.int64)
        yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"].astype("Int64"), "node": np.array(node, np.int64), "fp": prints, "keys": [bands(h) for h in grams]})
        del b
        pa.default_memory_pool().release_unused()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        known: dict[int, set[bytes]] = {}
        ok = []
        for i, s, t in zip(b["a"], b["s"], b["t"]):
            if i not in known:
                known = {i: shingles(s)}  # pairs of one hub come together
            ok.append(similar(known[i], shingles(t)))
        yield b.loc[ok, ["a", "b"]]
        del b
        pa.default_memory_pool().release_unused()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    t, s = texts.select(F.col("node").alias("b"), F.col("text").alias("t")), texts.select(F.col("node").alias("a"), F.col("text").alias("s"))
    return written(pairs.join(t, "b").join(s, "a").select("a", "s", "b", "t").mapInPandas(_verify, "a long, b long"), texts=True)


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"node": b["node"], "c": b["c"], "grams": [hashes(shingles(t)).view(np.int64) for t in b["text"]]})
        del b
        pa.default_memory_pool().release_unused()


def _front(rows: DataFrame, crowd: int) -> DataFrame:
    """The places of every row of rows (g, node, c, size, base, d) at which a pair within g can meet first: g, h, at and what _pairs() asks of both.

    d is the difference of a node's shingles to the base shingles of the text
    of its g (at first to none). Similar sets of sizes n and m differ in
    (n + m) / 9 shingles at most, so their differences to the same text have t
    shingles in common, with t = (w + w' - 2 base) / 18 and w as below. If
    one of the two is far, that is not similar to the text, t is above zero,
    and the rarest shingle that they share has t - 1 more behind it in both.
    The one of higher w probes, the other is indexed: its t is larger. Shingles
    of one row only come first in its order and meet nothing.
    """
    each = rows.select("g", "node", F.explode("d").alias("h"))
    shared = written(each.groupBy("g", "h").agg(F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = hot_join(each, shared, ["g", "h"], F.col("n"), total).groupBy("g", "node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("known"))
    less, whole = OF[1] - OF[0], OF[0] + OF[1]
    w = whole * F.size("d") - less * (F.col("size") - F.col("base"))
    rows = rows.join(known, ["g", "node"]).select("*", F.size("d").alias("k"), (F.size("d") - F.size("known")).alias("alone"), w.alias("w"), (w - 2 * less * F.col("base")).alias("over"))
    indexed = F.col("k") - F.ceil(F.greatest(F.col("w") + 1, F.col("w") + F.col("over")) / (2 * whole)).cast("int") + 1
    probing = F.when(F.col("over") > 0, F.col("k") - F.ceil(F.col("over") / (whole + less)).cast("int") + 1).otherwise(0)
    rare = F.col("alone") + F.size(F.filter("known", lambda x: x["n"] <= crowd))
    rows = rows.select("*", indexed.alias("indexed"), probing.alias("probing"), rare.alias("rare"))
    places = F.slice("known", 1, F.greatest(F.greatest("indexed", "probing") - F.col("alone"), F.lit(0)))
    own = ["g", "node", "c", "size", "base", "k", "w", "rare"]
    out = rows.select(*own, "alone", "indexed", "probing", F.posexplode(places).alias("i", "x")).withColumn("at", F.col("alone") + F.col("i"))
    return written(out.select(*own, "at", F.col("x.h").alias("h"), (F.col("at") < F.col("indexed")).alias("indexed"), (F.col("at") < F.col("probing")).alias("probing")))


def _pairs(front: DataFrame) -> DataFrame:
    """(a, b): the pairs of front that can be similar."""
    p, q = front.where("probing").alias("p"), front.where("indexed").alias("q")
    lengths = (F.col("p.size") * OF[1] >= F.col("q.size") * OF[0]) & (F.col("q.size") * OF[1] >= F.col("p.size") * OF[0])
    need = F.col("p.w") + F.col("q.w") - 2 * (OF[1] - OF[0]) * F.col("p.base")
    room = F.least(F.col("p.k") - F.col("p.at"), F.col("q.k") - F.col("q.at")) * 2 * (OF[0] + OF[1]) >= need
    order = (F.col("p.w") > F.col("q.w")) | ((F.col("p.w") == F.col("q.w")) & (F.col("p.node") > F.col("q.node")))
    pairs = p.join(q, (F.col("p.g") == F.col("q.g")) & (F.col("p.h") == F.col("q.h")) & (F.col("p.c") != F.col("q.c")) & order & lengths & room)
    return pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))


def _differences(sets: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For crowded places (front with n, mean): rows of the next _front(), and (a, b) of the texts that stand for them with those similar to them.

    A place's text is the one with the fewest shingles off the crowd, of the
    most usual size; places of one crowd mostly have the same.
    """
    total = crowded.count()
    usual = F.min(F.struct("rare", F.abs(F.col("size") - F.col("mean")).alias("off"), "node"))
    texts = crowded.groupBy("g", "h").agg(usual.alias("x"), F.count("*").alias("k__")).select("g", "h", "k__", F.col("x.node").alias("text"))
    members = hot_join(crowded.select("g", "h", "node", "c"), texts, ["g", "h"], F.col("k__"), total).select(F.col("text").alias("g"), "node", "c").distinct()
    members = written(members)
    salt = F.pmod(F.hash("node"), F.lit(SALTS)).alias("salt")
    texts = members.select(F.col("g").alias("node")).distinct().join(sets.select("node", F.col("c").alias("own"), F.col("grams").alias("their")), "node").withColumnRenamed("node", "g")
    texts = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = members.join(sets.select("node", "grams"), "node").select("*", salt).join(texts, ["g", "salt"])
    d = F.concat(F.array_except("grams", "their"), F.array_except("their", "grams"))
    rows = written(both.select("g", "node", "c", "own", F.size("grams").alias("size"), F.size("their").alias("base"), d.alias("d")))
    near = F.size("d") * (OF[0] + OF[1]) <= (F.col("size") + F.col("base")) * (OF[1] - OF[0])
    return rows.drop("own"), rows.where(near & (F.col("c") != F.col("own"))).select(F.least("g", "node").alias("a"), F.greatest("g", "node").alias("b"))


def prefix_pairs(rows: DataFrame, crowd: int | None = None) -> DataFrame:
    """(a, b), a < b: every pair of rows (node, c, text) of different c that can be similar, by the prefix filter.

    With crowd: pairs that connect the same rows. Where more than crowd rows on
    either side meet in a shingle, one text stands for them: those similar to
    it link to it, and of any other pair at least one is not similar to it, so
    the two meet by what they have in common in their differences to it, which
    is little in a crowd of separate edits. Crowds among these differences are
    split again, LEVELS times; what is then left meets pair by pair.
    """
    sets = written(rows.mapInPandas(_shingle_sets, "node long, c long, grams array<long>"), texts=True)
    now = sets.select(F.lit(0).cast("long").alias("g"), "node", "c", F.size("grams").alias("size"), F.lit(0).alias("base"), F.col("grams").alias("d"))
    if crowd is None:
        return _pairs(_front(now, 0)).distinct()
    found = []
    for level in range(LEVELS + 1):
        front = _front(now, crowd)
        sides = [F.count_if(side).alias(side) for side in ("indexed", "probing")]
        places = front.groupBy("g", "h").agg(*sides, F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.avg("size").alias("mean")).where("indexed > 0 and probing > 0 and low < high")
        places = written(places.select("g", "h", "n", "mean", (F.least("indexed", "probing") > crowd).alias("crowded")))
        total = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        front = written(hot_join(front, places, ["g", "h"], F.col("n"), total))
        crowded = front.where("crowded")
        if level == LEVELS or crowded.isEmpty():
            found.append(_pairs(front))
            break
        found.append(_pairs(front.where("not crowded")))
        now, near = _differences(sets, crowded)
        found.append(near)
    return reduce(DataFrame.unionByName, found).distinct()


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of every component of similar texts: that of the smallest doc_id, null ids last.

    Rows count by id and text, so rows with a null or repeated doc_id stay if
    their text has no copy; full repeats are one row. Texts without words are
    copies of each other. Texts (as words) and rows are told apart by 64-bit
    hashes. All columns stay.
    """
    ship(docs.sparkSession)
    row = row_key()
    rows = written(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_digests, "row long, doc_id long, node long, fp long, keys array<long>"), texts=True)
    # a text is a node; its first row speaks for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    best = written(rows.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys")))

    keys = best.select("node", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = written(hot_join(keys, hubs, ["key"], F.col("n"), BANDS * best.count()).select("key", "node", "hub"))
    # fingerprints within TAU bits: the first text of each speaks for it, and for texts with an equal one
    prints = best.where(F.size("keys") > 0).select("fp", "node")
    speakers = prints.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("k"))
    alike = prints.join(speakers.where("k > 1"), "fp").select("hub", "node")
    ring = links(speakers.select(F.col("hub").alias("node"), "fp")).select(F.col("a").alias("hub"), F.col("b").alias("node"))
    tried = shared.select("hub", "node").unionByName(alike).unionByName(ring).where("node <> hub")
    tried = written(tried.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    chosen = tried.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.select("node")).distinct()
    chosen = written(chosen.join(best, "node").select("node", F.col("first.row").alias("near_copy_row__")))
    texts = written(docs.select(row.alias("near_copy_row__"), "text").join(chosen.hint("shuffle_hash"), "near_copy_row__").groupBy("node").agg(F.min("text").alias("text")))
    found = _verified(tried, texts)
    linked = components(found)

    apart = written(shared.select("key", "node").join(linked, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    mixed = apart.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    members = apart.join(mixed, "key").select("node", "c").distinct()
    near = prefix_pairs(texts.join(members, "node").select("node", "c", "text"), CROWD)
    more = _verified(written(near.join(tried, ["a", "b"], "left_anti")), texts)
    if not more.isEmpty():
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = best.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("c"))
    kept = written(named.agg(F.min("first").alias("first")).select(F.col("first.row").alias("near_copy_row__")))
    return docs.withColumn("near_copy_row__", row).join(kept.hint("shuffle_hash"), "near_copy_row__", "left_semi").dropDuplicates(["near_copy_row__"]).select(*docs.columns)
