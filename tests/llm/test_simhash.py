import duckdb
import pytest
import xxhash

from evidentia.llm import simhash as S

DOCS = "doc_id long, text string, fp long, node long, component string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in prints:
        for b, y in prints:
            if a < b and bin(x ^ y).count("1") <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in prints}


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "one TWO", "a b c", "a\x0bb c d e", "É é ÀB ab c d", "word " * 70_000])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_whole_table_against_brute_force(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(prints)
    assert got == {i: (f, want[i]) for i, f in prints}


@pytest.mark.parametrize("dense", [1, 64])
def test_links_of_crowded_segments(spark, monkeypatch, dense):
    """Many fingerprints that share segments, by pairs and by one-bit neighbourhoods."""
    monkeypatch.setattr(S, "DENSE", dense)
    prints = [(i, v) for i, v in enumerate([0, 1, 3, 7, 15, 1 << 63, (1 << 63) | (1 << 62), 0b11 << 40, 0b1111 << 40, 5 << 21, (1 << 64) - 1, (1 << 64) - 2])]
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints], "node long, fp long")
    found = {r["node"]: r["component"] for r in S.components(S.links(nodes)).collect()}
    want = brute_components(prints)
    assert {i: found.get(i, i) for i, _ in prints} == want


def test_edge_rows(spark):
    rows = [(5, "a b c d", 1, 1, "x"), (3, "A B c d", 1, 1, "x"), (5, "a b c d", 1, 1, "x"), (9, None, 1, 1, "x"), (8, "", 1, 1, "x"), (None, "a b c d", 1, 1, "x"), (None, "zz yy xx ww vv", None, None, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 8, 8), (False, 9, 8), (True, 0, 0), (True, 0, 3)]
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_null_and_repeated_ids_link_by_their_texts(spark, monkeypatch):
    prints = {"first": 0, "middle": 3, "last": 15, "far": 0xFFFF << 20}
    monkeypatch.setattr(S, "fingerprints", lambda docs: docs.selectExpr("doc_id", "fp"))
    rows = [(1, "first"), (None, "middle"), (2, "last"), (5, "last"), (5, "far"), (9, "far")]
    df = spark.createDataFrame([(i, t, prints[t], 0, "x") for i, t in rows], DOCS)
    got = sorted((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in S.near_duplicates(df).collect())
    assert got == [(0, 3, 1), (1, 0, 1), (2, 15, 1), (5, 15, 1), (5, 0xFFFF << 20, 5), (9, 0xFFFF << 20, 5)]


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    monkeypatch.setattr("evidentia.llm.components.HOT", 2)
    star = [(0, i) for i in range(1, 300)] + [(300 + i, 299) for i in range(50)]
    edges = spark.createDataFrame(star, "a long, b long")
    assert {r["component"] for r in S.components(edges).collect()} == {0}
    rows = [(i, "one two three four" if i % 3 else f"other text number {i}") for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (1 if i % 3 else i) for i in range(60))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 200)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (1, 0)], "a long, b long")
    got = {r["node"]: r["component"] for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 200)}}
