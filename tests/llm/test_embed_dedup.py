import numpy as np
import pytest

from evidentia.llm import embed_dedup as E

VECTORS = "vec_id long, embedding array<float>, label int, v string, key string, cid long"


def brute(rows):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, np.float64)
    ids = sorted(ok)
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]) and E.exact_cosine(ok[a], ok[b]) >= 0.9:
                near[a].add(b)
                near[b].add(a)
    low = {i: i for i in ids}
    for _ in ids:
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in ids}
    return {i: (len(near.get(i, ())), low.get(i, i)) for i, _ in rows}


def vectors(seed, n=300, dim=6):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[: n // 3] = x[0] + 0.05 * rng.standard_normal((n // 3, dim)).astype(np.float32)  # a group with a third of the rows
    x[n // 2 : n // 2 + 10] = x[n // 2]
    x[-5:] = 3 * x[n // 2]
    return [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("unit,pivots", [(8192, 2048), (16, 2048), (16, 3)])
def test_against_all_pairs(spark, monkeypatch, unit, pivots):
    monkeypatch.setattr(E, "UNIT", unit)
    monkeypatch.setattr(E, "PIVOTS", pivots)
    rows = vectors(unit + pivots)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == brute(rows)


def test_replication_leaves_cells_out(spark, monkeypatch):
    """Clusters far apart: a vector goes to its own cell only."""
    monkeypatch.setattr(E, "UNIT", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [float(y) for y in np.eye(8, dtype=np.float32)[i % 8] + 0.02 * rng.standard_normal(8)]) for i in range(160)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (19, i % 8) for i in range(160)}
    classes = spark.createDataFrame([(i, 1, v) for i, v in rows], "cid long, copies long, v array<double>")
    monkeypatch.setattr(E, "SPARSE", 10)
    spread, units = E.replicated(classes, 8)
    guests = spread.where("guest = 1").count()
    assert units >= 8 and spread.where("guest = 0").count() == 160 and guests <= 0.15 * 160 * (units - 1) / 2


def test_small_tables_have_several_cells(spark):
    rows = vectors(7, n=600)
    df = spark.createDataFrame([(i, 1, v) for i, v in rows], "cid long, copies long, v array<float>")
    assert E.replicated(df, 6)[1] >= 4
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-30, 1e-32]), (12, [3e38, 1e37]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", "x", 1) for r in rows], VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(df).collect()}
    alone = {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}
    assert got == {**alone, **{i: (3, 1, i == 1) for i in (1, 2, 11, 12)}, None: (0, None, False)}
    twice = E.near_vectors(spark.createDataFrame([(1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in twice) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert E.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert E.near_vectors(spark.createDataFrame([(1, None, 1, "x", "x", 1)], VECTORS).limit(1)).count() == 1


def test_the_threshold_is_met_exactly():
    x = np.array([[1.0, 0.0]])
    for c in (0.9 - 1e-14, 0.9, 0.9 + 1e-14):
        y = np.array([[c, np.sqrt(1 - c * c)]])
        assert bool(E._hits(E.unit_length(x), E.unit_length(y), x, y)[0, 0]) == (E.exact_cosine(x[0], y[0]) >= 0.9)
