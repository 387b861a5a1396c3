import random
import re

import pytest

from evidentia.operators import boundaries as B

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts in which Dr., e.g. and J. stand before names and words, and other periods end sentences."""
    rng = random.Random(7)
    plain = ["today", "here", "dogs", "long", "end", "cats", "noon", "house", "walls", "train", "street", "river"]

    def sentence():
        words = rng.choices(plain, k=8)
        words.insert(rng.randrange(1, 8), rng.choice(["Dr. Smith", "Dr. Miller", "e.g. some", "J. Doe", "the", "we"]))
        return " ".join([rng.choice(["The", "We", "The", "Dogs", "Rivers"]), *words]) + rng.choice([".", ".", ".", "!", "?"])

    rows = [(i, " ".join(sentence() for _ in range(12)), "en") for i in range(60)]
    rows += [(100 + i, f"Am {i}. oktober kam der Zug. Der Zug war voll. Am Tag kam niemand. Der Tag war lang.", "de") for i in range(30)]
    return spark.createDataFrame(rows, DOCS).cache()


def test_abbreviations_are_learnt(spark, corpus):
    got = {(r["lang"], r["word"]): r for r in B.period_words(B.word_counts(corpus)).collect()}
    assert got["en", "dr"]["abbreviation"] and got["en", "e.g"]["abbreviation"]
    assert got["en", "dr"]["n"] == got["en", "dr"]["n_dot"] > 60
    assert not any(got["en", w]["abbreviation"] for w in ("today", "here", "dogs", "long", "end", "river"))
    assert ("en", B.NUMBER) not in got


def test_boundaries(spark, corpus):
    learnt = B.learn(corpus)
    assert {"the", "we"} <= {r["word"] for r in learnt.starters.where("lang = 'en'").collect()}
    rows = [
        (1, "We know Dr. Smith well. He came, e.g. by train. The end.", "en"), (2, "Asked of Dr. The end came.", "en"), (3, "A man J. Doe3 spoke. Then J. Roe left!\n\nWe stayed.", "en"),
        (4, "Es war der 3. oktober. Der Zug kam.", "de"), (5, None, "en"), (6, "", "en"), (7, "   ", None), (8, "Dr. Smith stays cut. No lang.", None), (None, "One. Two.", "en"), (None, "Three.", "en"), (9, "Wait... What? Yes.", "en"), (9, "Wait... What? Yes.", "en"),
    ]
    got = sorted(((r["doc_id"] or 0), r["sent_ix"], r["sentence"]) for r in B.sentences(spark.createDataFrame(rows, DOCS), learnt).collect())
    assert [r for r in got if r[0] == 1] == [(1, 0, "We know Dr. Smith well."), (1, 1, "He came, e.g. by train."), (1, 2, "The end.")]
    assert [r for r in got if r[0] == 2] == [(2, 0, "Asked of Dr."), (2, 1, "The end came.")]  # a starter ends it all the same
    assert [r[2] for r in got if r[0] == 3] == ["A man J. Doe3 spoke.", "Then J. Roe left!", "We stayed."]
    assert [r[2] for r in got if r[0] == 4] == ["Es war der 3. oktober.", "Der Zug kam."]
    assert not [r for r in got if r[0] in (5, 6, 7)]
    assert [r[2] for r in got if r[0] == 8] == ["Dr.", "Smith stays cut.", "No lang."]  # nothing was learnt of this language
    assert sorted(r[2] for r in got if r[0] == 0) == ["One.", "Three.", "Two."]
    assert len([r for r in got if r[0] == 9]) == 6


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert B.sentences(none, B.learn(none)).count() == 0
    rows = spark.createDataFrame([(1, "One. Two.", "en")], DOCS)
    assert B.sentences(rows, B.learn(none)).count() == 2


def test_joined_tables_give_the_same(spark, corpus, monkeypatch):
    learnt = B.learn(corpus)
    one = sorted(map(tuple, B.sentences(corpus, learnt).collect()))
    monkeypatch.setattr(B, "SENT_ROWS", -1)
    assert one == sorted(map(tuple, B.sentences(corpus, learnt).collect()))


def bare(w):
    return re.sub(r"^[(\"'\[]+|[)\"'\],;:]+$", "", w)


def kind(w):
    w = re.sub(r"\.$", "", w).lower()
    return "##" if re.match(r"^[0-9][0-9.,]*$", w) else w if any(c.isalnum() for c in w) else ""


def test_whole_table_against_a_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = B.learn(docs)
    short, begin, common = ({tuple(r) for r in t.collect()} for t in (learnt.abbreviations, learnt.starters, learnt.lower))
    together = {tuple(r) for r in learnt.collocations.collect()}
    want = []
    for d in docs.collect():
        lang, open_, n = d["lang"] or "und", [], 0
        pieces = [p for p in re.split("\x01", re.sub(r"([.!?])\s+", "\\1\x01", (d["text"] or "").strip(" \t\n\x0b\f\r"), flags=re.A)) if p.strip()]
        for i, p in enumerate(pieces):
            open_.append(p.strip())
            goes_on = False
            if i + 1 < len(pieces):
                last, first = bare(p.split()[-1]), bare(pieces[i + 1].split()[0])
                w, f = kind(last), kind(first)
                up, small = first[:1].isupper(), first[:1].islower()
                if last.endswith(".") and not last.endswith(".."):
                    goes_on = (lang, w) in short and (small or ((lang, f) not in begin and not (up and (lang, f) in common)))
                    goes_on |= (lang, w, f) in together or (w == "##" and small)
                    goes_on |= len(w) == 1 and w.isalpha() and up and (lang, f) not in common and (lang, f) not in begin
            if not goes_on:
                want.append((d["doc_id"], n, " ".join(open_)))
                open_, n = [], n + 1
    assert sorted(map(tuple, B.sentences(docs, learnt).collect())) == sorted(want)
