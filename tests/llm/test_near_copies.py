import random
from itertools import combinations

import duckdb

import corpus_pipeline as P
from evidentia.llm import near_copies as N

DOCS = "doc_id long, text string, key string"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}


def brute_kept(rows):
    """Smallest doc_id of every component of texts with Jaccard similarity 0.8, by all pairs."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        a, b = sets[x], sets[y]
        if 5 * len(a & b) >= 4 * len(a | b):
            root[find(y)] = find(x)
    best = {}
    for x, (i, _) in enumerate(rows):
        best[find(x)] = min(best.get(find(x), i), i)
    return sorted(best.values())


def stage(spark, rows):
    return P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")


def test_edited_copies_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        w = [rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(120)]
        for k in range(4):
            e = list(w)
            for _ in range(k):
                e[rng.randrange(len(e))] = f"new{rng.random()}"
            rows.append((10 * i + k, " ".join(e)))
    want = brute_kept(rows)
    assert len(want) < 80 and sorted(r["doc_id"] for r in stage(spark, rows).collect()) == want


def test_table_against_all_pairs(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == brute_kept(rows)


def test_chains_and_crowded_bands(spark):
    w = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w[i:] + [f"x{j}" for j in range(i)])) for i in range(0, 60, 3)] + [(100 + i, " ".join([*w, f"end{i}"])) for i in range(80)]
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == brute_kept(rows)


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, "zz yy xx ww vv", "a"), (None, "another text of its own", "b"), (None, f"{long} end", "c"), (5, long, "d"), (5, "five again, another text", "e"), (5, long, "d"), (7, None, "f"), (8, " ", "g"), (None, "", "h")]
    kept = P.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    assert kept.columns == ["doc_id", "text", "key"] and sorted(r["key"] for r in kept.collect()) == ["a", "b", "d", "e", "f"]
    assert P.drop_near_copies(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_prefix_filter_loses_no_pair(spark):
    """Texts of a crowd around the bound, whatever shares a band: all pairs at 0.8 are proposed, and few others."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = base[: rng.choice([120, 135, 150])]
        for k in sorted(rng.sample(range(len(w)), rng.randrange(12))):
            w[k] = f"x{rng.randrange(40)}"
        rows.append((i, i, " ".join(w)))
    rows += [(200 + i, 200 + i, " ".join(rng.choices(base, k=30))) for i in range(60)] + [(300, 300, ""), (301, 301, "a b"), (302, 302, "a b")]
    got = {(r["a"], r["b"]) for r in N.prefix_pairs(spark.createDataFrame(rows, "node long, c long, text string")).collect()}
    sets = {i: grams(t) for i, _, t in rows}
    near = {(x, y) for x, y in combinations(sorted(sets), 2) if sets[x] and sets[y] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
    assert near and near <= got
    pairs = len(rows) * (len(rows) - 1) // 2
    assert len(got) < pairs / 4


def connected(sets, pairs):
    """The classes of the ids of sets under those pairs that are similar."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        if sets[x] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
            x, y = sorted((find(x), find(y)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_crowd_of_separate_edits_does_not_meet_pair_by_pair(spark):
    """Copies with 1 to 5 words of their own, with and without the text they come from: few pairs, the same classes as all pairs give."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, 0, " ".join(base))]
    for i in range(1, 500):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 5)):
            w[k] = f"x{i}.{k}"
        rows.append((i, i, " ".join(w)))
    for some in (rows, rows[1:]):
        got = {(r["a"], r["b"]) for r in N.prefix_pairs(spark.createDataFrame(some, "node long, c long, text string"), 16).collect()}
        sets = {i: grams(t) for i, _, t in some}
        assert len(got) < 12 * len(some) and connected(sets, got) == connected(sets, combinations(sorted(sets), 2))


def test_crowds_within_crowds_lose_no_link(spark):
    """Chains of edits from few words, cut and joined texts, of all sizes: whatever a crowd is, the classes are those of all pairs."""
    for seed in (1, 2):
        rng = random.Random(seed)
        base = [f"w{i}" for i in range(40 + 30 * seed)]
        rows, made = [], [base]
        for i in range(160):
            w = list(rng.choice(made))
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [f"x{rng.randrange(9)}"], [w[k], f"y{rng.randrange(9)}"]])
            w = rng.choice([w, w, w, w[rng.randrange(6) :], w + base[: rng.randrange(8)]])
            made.append(w)
            rows.append((i, i // rng.choice([1, 1, 1, 8]), " ".join(w)))
        rows.append((500, 500, ""))
        sets = {i: grams(t) for i, _, t in rows}
        alike = [(x[0], y[0]) for x, y in combinations(rows, 2) if x[1] != y[1]]
        got = {(r["a"], r["b"]) for r in N.prefix_pairs(spark.createDataFrame(rows, "node long, c long, text string"), 2).collect()}
        classes = {}
        for i, c, _ in rows:
            classes.setdefault(c, []).append(i)

        def whole(pairs):
            """Classes under pairs, where rows of one c are one already."""
            of = connected(sets, pairs)
            root = {i: i for i in of}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for i, r in of.items():
                root[find(i)] = find(r)
            for m in classes.values():
                for x in m:
                    root[find(x)] = find(m[0])
            least = {}
            for i in sorted(of):
                least.setdefault(find(i), i)
            return {i: least[find(i)] for i in of}

        assert whole(got) == whole(alike)
