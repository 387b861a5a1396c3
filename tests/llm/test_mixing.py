import math

from evidentia.llm import mixing as M

DOCS = "doc_id long, text string, source string, size long, rng int, target double, taken long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1.0, 1) for r in rows], DOCS)


def filled(sizes):
    """Targets by sharing out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        for s in full or open_:
            got[s] = 2.0 * sizes[s] if full else level * w[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return got


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (i % 9), "abcdé"[i % 5] if i % 11 else None) for i in range(400)]
    got = M.mix(docs(spark, rows)).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + i % 9
    want, by = filled(sizes), {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = by[r["doc_id"]]
        assert r["size"] == r["doc_id"] % 9 and r["source_size"] == sizes[s] and math.isclose(r["target"], want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 8 for s in want)
    again = {r["doc_id"]: r["taken"] for r in M.mix(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_epochs_come_before_the_fraction(spark):
    rows = [(i, "a b c", "a") for i in range(30)] + [(100 + i, "a b c", "b") for i in range(300)]
    for r in M.mix(docs(spark, rows)).collect():
        assert r["taken"] == r["size"] * (r["epochs"] + r["selected"])
        assert r["doc_id"] >= 100 or r["taken"] == 6


def test_heavier_documents_come_first(spark):
    rows = [(i, "a b", s) for s, a in (("a", 0), ("b", 1000), ("c", 2000)) for i in range(a, a + 1000)]
    w = spark.createDataFrame([(i, 9.0 if i % 2 else 0.1) for i in range(3000)] + [(None, 1.0), (4, None), (6, -1.0)], "doc_id long, weight double")
    got = [r for r in M.mix(docs(spark, rows), w).collect() if r["doc_id"] >= 2000 and r["selected"]]
    assert len(got) < 900 and sum(r["doc_id"] % 2 for r in got) > 490  # all but a few of the 500 heavy ones


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t ", None), (None, "x y", "b"), (4, "x y", "b"), (4, "x y", "b"), (5, "one\x0btwo three", "c")]
    got = M.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["size"] for r in got} == {1: 0, 2: 0, 3: 0, None: 2, 4: 2, 5: 2}
    assert all(r["taken"] == 0 for r in got if not r["size"])
    assert M.mix(docs(spark, [])).count() == 0
    out = M.mixed_documents(docs(spark, [(1, "a b", "a"), (2, "c", "b")]))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_null_and_repeated_ids_are_mixed(spark):
    rows = [(None, "one of its own", "a"), (None, "two of its own", "a"), (4, "three is here", "a"), (4, "four is here", "a")]
    out = [(r["doc_id"], r["text"]) for r in M.mixed_documents(docs(spark, rows)).collect()]
    taken = sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in M.mix(docs(spark, rows)).collect())
    assert {t for _, t in out} == {t for _, t, _ in rows} and len(out) == sum(n // size for _, size, n in taken)


def test_ranges_change_nothing_and_null_ids_spread(spark, monkeypatch):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(300)] + [(None, f"t{i} words here", "a") for i in range(200)]
    key = lambda out: sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in out.collect())
    want = key(M.mix(docs(spark, rows)))
    monkeypatch.setattr(M, "RANGES", 1)
    monkeypatch.setattr(M, "ROWS", 20)
    assert key(M.mix(docs(spark, rows))) == want
    drawn = docs(spark, rows).where("doc_id is null").select(M._uniform(M.F.col("doc_id"), M.F.col("text")).alias("u")).distinct().count()
    assert drawn == 200
