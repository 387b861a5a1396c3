import pytest
from pyspark.sql import functions as F

from evidentia.functions import hashing as H
from evidentia.functions import text as T
from evidentia.functions import urls as U
from evidentia.operators import entities as N


def value(spark, f, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,clean",
    [
        ("The senator​  said\n\n\n\nthat...", "The senator said that.."),
        ("", ""),
        ("I don't know, it's <b>bold</b> http://a.example/x me@b.example", "I do not know, it is bold"),
        ("soooo good / ,. = $ % x", "soo good $ %"),
        ("don’t", "dont"),
        ("a I b é", "a I"),
    ],
)
def test_normalize(spark, text, clean):
    assert value(spark, lambda c: T.normalize(T.nfkc(T.text(c))), text) == clean


def test_normalize_damages_marks_as_specified(spark):
    assert value(spark, lambda c: T.normalize(c), "हिन्दी") == "हनद"


def test_sentences_and_junk(spark):
    text = "  It was a sunny day in Mumbai. Short one! Source: somewhere on the web page here. See http://a.example/b for it. Was it so?  It was the very last one."
    assert value(spark, T.sentences, text)[-1] == "It was the very last one."
    kept = value(spark, lambda c: F.filter(T.sentences(c), lambda s: ~T.is_junk_sentence(s)), text)
    assert kept == ["It was a sunny day in Mumbai.", "It was the very last one."]


def test_words_tokens_years_numbers(spark):
    assert value(spark, T.words, "  a b\tc ") == ["a", "b", "c"]
    assert value(spark, T.tokens, "Don't हिन्दी 5G_x") == ["don", "t", "हिन्दी", "5g_x"]
    assert value(spark, T.years, "in 1999, 2024 and 20245") == [1999, 2024]
    assert value(spark, T.query_year, "from 2099 to 2031") == "2031"
    assert value(spark, T.standalone_numbers, "1,200.5 and 7") == ["1,200.5", "7"]
    assert value(spark, T.has_devanagari, "x हि") and not value(spark, T.has_devanagari, "x")


def test_plain_words_of_a_headline(spark):
    assert value(spark, T.plain_words, "As Trump Accuses Iran, He Has One Problem: His Own Credibility") == ["trump", "accuses", "iran", "problem", "credibility"]


def test_jaccard_and_first_of_each(spark):
    assert value(spark, T.keyword_jaccard, "Heavy rain lashes Mumbai 2024", "Heavy rain lashes Mumbai") == 0.8
    assert value(spark, T.keyword_jaccard, "the of", "rain") == 0.0
    assert spark.sql("select array(' A ', 'a', '', 'b', 'B ') as q").select(T.first_of_each(F.col("q")).alias("v")).first()["v"] == ["A", "b"]


@pytest.mark.parametrize(
    "url,authority,kind,social",
    [
        ("https://www.altnews.in/x", 0.95, "fact_checker", False),
        ("https://pib.gov.in/a", 0.95, "fact_checker", False),
        ("https://www.cdc.gov/a", 1.0, "government", False),
        ("https://bbc.com/news", 0.85, "news", False),
        ("https://www.reddit.com/r/news/1", 0.45, "social_media", True),
        ("https://netflix.com/t", 0.45, "social_media", False),
        ("https://example.org/", 0.55, "web", False),
        ("", 0.1, "unknown", False),
        (None, 0.1, "unknown", False),
    ],
)
def test_source_quality(spark, url, authority, kind, social):
    assert value(spark, U.source_type, url) == kind
    assert value(spark, lambda c: U.authority(U.source_type(c)), url) == authority
    assert bool(value(spark, lambda c: F.coalesce(U.is_social(c), F.lit(False)), url)) == social


def test_authors(spark):
    want = {"https://x.com/alice/status/1": "@alice", "https://www.reddit.com/r/news/1": "r/news", "https://www.instagram.com/p/abc": "", "https://www.youtube.com/@dave/x": "@dave", "https://example.org/a": ""}
    assert {u: value(spark, U.author_from_path, u) for u in want} == want


def test_hashes(spark):
    a, b, c = "945a638b65a93eb2", "945a638b65a93eb3", "0000000000000000"
    assert [value(spark, H.hamming, a, x) for x in (a, b, c, "invalid!", None)] == [0, 1, 32, 64, 64]
    assert value(spark, lambda x: H.similarity(x.cast("int")), "1") == 98.4
    assert value(spark, H.sanitize_filename, "a b/c?.PNG") == "a_b_c_.png"
    assert len(value(spark, H.sanitize_filename, "x" * 100 + ".jpeg")) == 64


def test_entities(spark):
    e = value(spark, N.entities, "Elon Musk said Tesla will build a factory in Texas by 2025, costing $5 billion.")
    assert "Elon Musk" in e["persons"] and "Tesla" in e["orgs"] and "Texas" in e["locations"] and "2025" in e["dates"] and "$5 billion" in e["numbers"]
    e = value(spark, N.entities, "MUMBAI police and the election commission in sector 7; Officials say 1.3 crore voters")
    assert e["locations"] == ["MUMBAI"] and "sector 7" in e["concepts"] and "1.3 crore" in e["numbers"] and e["persons"] == []
    assert value(spark, N.entities, None)["persons"] == []
