import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from evidentia.llm import phrases as P
from evidentia.llm.queries import op13_collocations
from evidentia.llm.sql import OP13

SCHEMA = "lang string, text string, phrase string, n int, rank int"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, told=2000, covered=100):
    count, out = {}, set()
    for lang, text, *_ in rows:
        c = count.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    for lang, c in count.items():
        n, found = sum(v for k, v in c.items() if len(k) == 1), []
        often = [k for k, v in c.items() if len(k) > 1 and v >= least]
        inside = {k: max((c[x] for x in often if len(x) > len(k) and any(x[i : i + len(k)] == k for i in range(len(x)))), default=0) for k in often}
        for k in often:
            score, cut = min((1000 * c[k] * n // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
            if not inside[k] or 100 * inside[k] < covered * c[k]:
                found.append((-score, -c[k], " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out |= {(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:told], 1)}
    return out


def rows(n, seed, words="a b c d e é Zz q\x01 q \x00 日 x-y".split(" ")):
    rng = random.Random(seed)
    seps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "!", "\x0b"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words[: 2 + i % 11]) + rng.choice(seps) for i in range(rng.randrange(60))), "p", 1, 2) for _ in range(n)] + [(None, None, "p", 1, 2), ("en", "", "p", 1, 2), ("xx", "once only", "p", 1, 2)]


def told(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("numbered", [P.NUMBERED, 0])
@pytest.mark.parametrize("least,first,covered", [(5, 2000, 100), (3, 7, 60), (1, 2000, 100)])
def test_against_brute_force(spark, numbered, least, first, covered):
    """With words as numbers and with the words themselves."""
    data = rows(120 if least > 1 else 30, least)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = P.collocations(df, least=least, told=first, covered=covered, numbered=numbered)
    assert got.columns == list(COLUMNS) and told(got) == brute(data, least, first, covered)


@pytest.mark.parametrize("numbered", [P.NUMBERED, 0])
def test_hot_text_and_long_pieces(spark, monkeypatch, numbered):
    """Copies of one line, and a piece longer than a task's chunk."""
    monkeypatch.setattr(P, "CHUNK", 64)
    long = " ".join(random.Random(5).choices("abcdefg", k=1000))
    data = [("en", "to be or not to be that is", "p", 1, 2)] * 300 + [("en", long, "p", 1, 2), ("de", long, "p", 1, 2)] + rows(20, 9)
    got = P.collocations(spark.createDataFrame(data, SCHEMA).repartition(7), least=8, numbered=numbered)
    assert told(got) == brute(data, 8)


def test_growth_in_parts():
    """Sorted pointers cut anywhere: prefixes at the cuts are told in parts whose sums are whole."""
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 3000)
    (k0, k1), n = P._windows(ids, len(ids))
    columns = [np.zeros(len(n), np.int64), *P._unpacked(k0, k1)]
    want = Counter()
    for i in range(len(ids) - 1):
        for d in range(2, 6):
            if 0 in (w := tuple(ids[i : i + d].tolist())) or len(w) < d:
                break
            want[w] += 1
    for parts in (1, 3, 50):
        got, cuts = Counter(), np.linspace(0, len(n), parts + 1).astype(int)
        for lo, hi in zip(cuts, cuts[1:]):
            part = [c[lo:hi] for c in columns]
            got.update({tuple(int(c[s]) for c in part[1 : d + 1]): t for s, d, t in P.grow(part, n[lo:hi], 40)})
        assert {k: v for k, v in got.items() if v >= 40} == {k: v for k, v in want.items() if v >= 40}


def test_scores_above_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**12)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 9 * 10**13 + 7)], "lang string, n long")
    assert P.scored(phrases, totals).first()["score"] == 1000 * 10**12 * (9 * 10**13 + 7) // (3 * 10**24)


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = told(op13_collocations(spark, sf))
    assert got == set(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13})").fetchall()) and len(got) > 20
