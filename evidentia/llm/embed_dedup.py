"""Embedding near-duplicates: an exact metric range join on the angle.

Pivots partition the vectors into cells by nearest pivot. A vector within the
range of something in another cell lies near that cell: by the triangle
inequality its angle to the cell's pivot is at most the cell's radius plus the
range, and it is no farther from the bisector of the two pivots than the
range. Vectors are replicated to the cells for which both hold, and cells join
independently. A cell above UNIT vectors is cut into units that join one by
one; of two units the vectors of the lower one go to the higher one, so each
pair meets once. A unit streams what is replicated to it past its own vectors
and emits counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_sample, ship, written
from evidentia.llm.components import components, hot_join

COSINE = 0.9
#: Vectors of a unit, and most pivots (what is sent to every task).
UNIT, PIVOTS = 8_192, 2_048
#: Pivots of small tables: one for so many vectors, up to so many.
SPARSE, FEW = 100, 16
#: Slack of the replication bounds, and the band in which a cosine is computed again exactly.
SLACK, BAND = 1e-9, 1e-12
_CHUNK = 1_024


def _pack(v: np.ndarray) -> bytes:
    small = v.astype(np.float32)
    return (small if (small == v).all() else v).tobytes()


def _unpack(rows: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in rows], np.float64).reshape(len(rows), dim)


def unit_length(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no component's square leaves the doubles
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def _hits(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray) -> np.ndarray:
    g = a @ b.T
    out = g >= COSINE
    for i, j in zip(*np.nonzero(np.abs(g - COSINE) < BAND)):
        out[i, j] = exact_cosine(raw_a[i], raw_b[j]) >= COSINE
    return out


class Unit:
    """A unit's own vectors: link counts and the forest that connects them."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray) -> None:
        self.ids, self.weights, self.raw = ids, weights, raw
        self.x = unit_length(raw)
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))
        for at in range(0, len(ids), _CHUNK):
            hit = _hits(self.x[at : at + _CHUNK], self.x[at:], raw[at : at + _CHUNK], raw[at:])
            hit &= np.arange(hit.shape[1])[None, :] > np.arange(hit.shape[0])[:, None]  # each pair once, no vector with itself
            self.links[at : at + hit.shape[0]] += hit @ weights[at:]
            self.links[at:] += weights[at : at + hit.shape[0]] @ hit
            for i in np.nonzero(hit.any(axis=1))[0]:
                self._join(np.append(np.nonzero(hit[i])[0] + at, at + i))

    def _join(self, rows: np.ndarray) -> None:
        roots = np.unique(self.root[rows])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def meet(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray) -> list[tuple[int, int, int]]:
        """(id, links, one own id linked) for the replicated vectors that link."""
        out = []
        for at in range(0, len(ids), _CHUNK):
            part = slice(at, at + _CHUNK)
            hit = _hits(unit_length(raw[part]), self.x, raw[part], self.raw)
            if not hit.any():
                continue
            self.links += weights[part] @ hit
            counts = hit @ self.weights
            for j in np.nonzero(counts)[0]:
                rows = np.nonzero(hit[j])[0]
                self._join(rows)
                out.append((int(ids[at + j]), int(counts[j]), int(self.ids[rows[0]])))
        return out

    def rest(self) -> list[tuple[int, int, int]]:
        linked = np.nonzero((self.links > 0) | (self.root != np.arange(len(self.root))))[0]
        return [(int(self.ids[i]), int(self.links[i]), int(self.ids[self.root[i]])) for i in linked]


def replicated(classes: DataFrame, dim: int) -> tuple[DataFrame, int]:
    """classes (cid, copies, v) of one dimension -> (cid, copies, vec, unit, guest) and the number of units.

    Each vector is in its own unit once (guest 0), and a guest of the later
    units that may hold something within the range.
    """
    spark = classes.sparkSession
    n = classes.count()
    wanted = min(PIVOTS, max(1, (64 << 20) // (8 * dim)), max(1, -(-n // UNIT), min(FEW, n // SPARSE)))
    chosen = bounded_sample(classes, "cid", wanted).select("v").collect()  # at most PIVOTS vectors, 64 MB
    pivots = unit_length(np.array([r["v"] for r in chosen], np.float64))
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = np.array(b["v"].tolist(), np.float64).reshape(len(b), dim)
            dots = unit_length(raw) @ sent.value.T
            home = dots.argmax(axis=1)
            angle = np.arccos(np.clip(dots[np.arange(len(b)), home], -1, 1))
            yield pd.DataFrame({"cid": b["cid"], "copies": b["copies"], "vec": pd.Series([_pack(v) for v in raw], dtype=object), "cell": home, "angle": angle})

    homes = written(classes.mapInPandas(assign, "cid long, copies long, vec binary, cell int, angle double"))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row per pivot
    parts = np.array([-(-cells.get(c, (0, 0.0))[0] // UNIT) for c in range(len(pivots))])
    radius = np.array([cells.get(c, (0, 0.0))[1] for c in range(len(pivots))])
    first = np.cumsum(parts) - parts
    span = math.acos(COSINE)
    plan = spark.sparkContext.broadcast((parts, radius, first))

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, radius, first = plan.value
        piv = sent.value
        apart = np.sqrt(np.maximum(((piv[:, None, :] - piv[None, :, :]) ** 2).sum(axis=2), 0)) if len(piv) <= 256 else None
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.iloc[at : at + 512]
                dots = unit_length(_unpack(b["vec"], dim)) @ piv.T
                home = b["cell"].to_numpy()
                own = dots[np.arange(len(b)), home][:, None]
                gap = apart[home] if apart is not None else np.sqrt(np.maximum(((piv[home][:, None, :] - piv[None]) ** 2).sum(axis=2), 0))
                near = (own - dots <= (math.sin(span) + SLACK) * gap + SLACK) & (np.arccos(np.clip(dots, -1, 1)) <= radius[None, :] + span + SLACK)
                unit = first[home] + b["cid"].to_numpy() % np.maximum(parts[home], 1)
                row, to = list(range(len(b))), unit.tolist()
                for c in range(len(piv)):
                    reach = np.nonzero(near[:, c] | (home == c))[0]
                    for u in range(first[c], first[c] + parts[c]):
                        r = reach[unit[reach] < u]
                        row.extend(r.tolist())
                        to.extend([u] * len(r))
                row = np.array(row)
                guest = (np.arange(len(row)) >= len(b)).astype(np.int8)
                out = b[["cid", "copies", "vec"]].iloc[row].reset_index(drop=True)
                yield out.assign(unit=np.array(to, np.int64), guest=guest)

    return homes.mapInPandas(replicate, "cid long, copies long, vec binary, unit long, guest byte"), int(parts.sum())


def _range_join(classes: DataFrame, dim: int) -> DataFrame:
    """classes (cid, copies, v) of one dimension -> (cid, links, other): partial link counts and forest edges."""
    spread, units = replicated(classes, dim)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, now, own = None, None, []

        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["cid", "links", "other"], dtype="int64")

        def arrays(b: pd.DataFrame) -> tuple:
            return b["cid"].to_numpy(), b["copies"].to_numpy(), _unpack(b["vec"], dim)

        def ready() -> Unit:
            return Unit(*(np.concatenate(x) for x in zip(*own)))

        for b in batches:
            for number, g in b.groupby("unit", sort=False):
                if number != unit:
                    if own:
                        yield frame((now or ready()).rest())
                    unit, now, own = number, None, []
                home, guests = g[g["guest"] == 0], g[g["guest"] == 1]
                if len(home):
                    own.append(arrays(home))
                if len(guests):
                    now = now or ready()
                    yield frame(now.meet(*arrays(guests)))
        if own:
            yield frame((now or ready()).rest())

    spread = spread.repartition(max(1, min(units, 20_000)), "unit").sortWithinPartitions("unit", "guest")
    return spread.mapInPandas(join, "cid long, links long, other long")


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors of different length never link; null, empty and zero vectors, and
    such with null or non-finite components, link with nothing, nor do rows
    without vec_id, whose component_id is null. Repeated rows are other vectors
    of the same content. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False)))
    rows = written(rows.select("vec_id", F.when(F.col("ok"), F.col("v")).alias("v"), F.when(F.col("ok"), F.sha2(F.to_json(F.struct("v")), 256)).alias("key")))
    classes = rows.where("key is not null").groupBy("key", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = None
    for r in classes.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():  # the lengths in use
        part = _range_join(classes.where(F.size("v") == r["dim"]).select("cid", "copies", "v"), r["dim"])
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(found)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(found.where("cid <> other"), "cid", "other").select(F.col("node").alias("cid"), "component")
    named = written(classes.select("key", "cid", "rep", "copies").join(links, "cid", "left").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"))
    named = hot_join(named, least, ["component"], F.col("k"), named.count()).select("key", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = hot_join(rows.select("vec_id", "key"), named, ["key"], F.col("copies"), rows.count(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
