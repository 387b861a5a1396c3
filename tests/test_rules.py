import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import claims as C
from evidentia.operators import consistency as K
from evidentia.operators import evidence as E
from evidentia.operators import images as I
from evidentia.operators import ocr as O
from evidentia.operators import sentiment as S
from evidentia.operators import social
from evidentia.operators import verdicts as V

CLAIM = "Government announced a nationwide 5G ban"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,is_social,relation,confidence",
    [
        ("Officials denied the nationwide ban report.", False, "CONTRADICTS", 0.90),
        ("He withheld the nationwide plan yesterday.", False, "SUPPORTS", 0.88),
        ("The nationwide policy was alleged by critics.", False, "ATTRIBUTED_CLAIM", 0.82),
        ("The nationwide weather remained mild.", False, "CONTEXT", 0.60),
        ("Weather mild.", False, "IRRELEVANT", 0.85),
        ("Look at this video everyone", True, "SOCIAL_VIRAL_POST", 0.80),
        ("Interesting topic today folks", True, "CONTEXT", 0.65),
        ("", False, "IRRELEVANT", 0.0),
        (None, True, "IRRELEVANT", 0.0),
    ],
)
def test_classify(spark, text, is_social, relation, confidence):
    r = one(spark, E.classify(F.lit(CLAIM), F.lit(text).cast("string"), F.lit(is_social)))
    assert (r["relationship"], r["confidence"]) == (relation, confidence)
    if relation == "CONTRADICTS":
        assert "'denied'" in r["reason"]


def test_relevance(spark):
    rel = lambda c, d, s=False, orgs=None: one(spark, E.relevance(F.lit(c), F.lit(d), F.lit(s), None if orgs is None else F.array(*map(F.lit, orgs))))
    assert not rel("", "x")["relevant"] and not rel(CLAIM, "short", True)["relevant"]
    assert rel(CLAIM, "everyone talks about the government", True)["score"] == 0.75
    assert not rel(CLAIM, "cats sit on warm window sills all day", True)["relevant"]  # falls through to the article rules
    r = rel(CLAIM, "The government is nationwide in the news", False)
    assert r["relevant"] and r["score"] == pytest.approx(2 / 3 + 0.3)
    assert not rel(CLAIM, "government nationwide", False, ["Tesla Motors", "Reuters"])["relevant"] and rel(CLAIM, "government nationwide", False, ["Tesla Motors"])["relevant"]


def test_gate_and_confidence(spark):
    why = lambda c: one(spark, C.reject_reason(F.lit(c)))
    assert why(CLAIM) is None and why("BREAKING NEWS").startswith("Too few") and why("!!! ??? ... a").startswith("Contains") and why("").startswith("Too few")
    assert one(spark, C.confidence(F.lit(CLAIM), F.lit(None).cast("double"))) == 0.5
    assert one(spark, C.confidence(F.lit(CLAIM + " in all states"), F.lit(0.97))) == 1.0


def test_claim_extraction(spark):
    rows = spark.createDataFrame([(1, "Hello! Is anyone there? The sky is green and water is dry. I think so."), (2, "Nothing stated here really?"), (3, "Short claim text"), (4, None), (5, "Prices rose in May, but the minister denied any link, and therefore all stayed calm.")], "id int, text string")
    got = {}
    for r in C.extract(rows).orderBy("id", "claim_ix").collect():
        got.setdefault(r["id"], []).append(r["claim"])
    assert got[1] == ["The sky is green and water is dry."] and 2 not in got and got[3] == ["Short claim text"] and 4 not in got
    assert got[5] == ["Prices rose in May", "the minister denied any link, and therefore all stayed calm."]


def test_queries(spark):
    rows = spark.createDataFrame([(1, "President Smith signed the climate bill in Paris.", ["Smith"], ["Paris"]), (2, "The vote was held in 2019", None, None), (3, " ", None, None)], "id int, claim string, p array<string>, l array<string>")
    q = {r["id"]: r["queries"] for r in C.with_queries(rows, names="p", locations="l").collect()}
    assert q[3] == [] and len(q[1]) == 5 and any("Smith" in x for x in q[1]) and any("Paris" in x for x in q[1])
    assert q[1][1] == "Smith Paris" and q[2][0] == '"The vote was held in 2019"' and len(q[2]) == 5 and len({x.lower() for x in q[2]}) == 5
    routed = one(spark, C.routed_queries(F.array(*map(F.lit, q[1]))))
    assert [x.startswith("(site:") for x in routed] == [False, False, True, True]
    assert one(spark, C.usable_queries(F.array(F.lit("abc "), F.lit("abcd")))) == ["abcd"]


def test_accepted_hits(spark):
    hits = [(1, CLAIM, 0, 0, "http://a", "About cats", ""), (1, CLAIM, 1, 0, "http://a", "government news", ""), (1, CLAIM, 1, 1, "http://b", "", "nationwide"), (1, CLAIM, 0, 2, "https://x.com/p/1", "", ""), (1, CLAIM, 2, 0, "http://b", "nationwide", ""), (1, CLAIM, 0, 1, None, "nationwide", ""), (2, "it is so", 0, 0, "http://c", "", "")]
    df = spark.createDataFrame(hits, "claim_id int, claim string, q_ord int, hit_ord int, url string, title string, snippet string")
    got = sorted((r["claim_id"], r["rank"], r["url"], r["q_ord"]) for r in C.accept_hits(df).collect())
    assert got == [(1, 1, "https://x.com/p/1", 0), (1, 2, "http://a", 1), (1, 3, "http://b", 1), (2, 1, "http://c", 0)]


@pytest.mark.parametrize(
    "scores,score,label",
    [
        ((0.8, 0.2, 0.1, 0), 0.3, "LIKELY_MANIPULATED"),
        ((0.1, 0.1, 0.9, 0), None, "UNKNOWN"),
        ((0, 0, 0, 0), 0, "LIKELY_AUTHENTIC"),
        ((0.5, 0.5, 0.8, 0), 0.65, "POSSIBLY_AI_GENERATED"),
        ((0.9, 0.9, 0.9, 0), 0.9, "LIKELY_AI_GENERATED"),
        ((0.3, 0.3, 0.1, 0), 0.2, "POSSIBLY_AUTHENTIC"),
        ((0.1, 0.1, 0.1, 0.6), 0.1, "LIKELY_MANIPULATED"),
        ((0.65, 0.1, 0.1, 0), 0.2375, "POSSIBLY_MANIPULATED"),
        ((0.5, 0.4, 0.2, 0), None, "UNKNOWN"),
        ((None, None, None, None), 0, "LIKELY_AUTHENTIC"),
    ],
)
def test_ai_likelihood(spark, scores, score, label):
    r = one(spark, I.ai_likelihood(*[F.lit(x).cast("double") for x in scores]))
    assert (r["score"], r["label"]) == (score, label)


def test_consistency(spark):
    def run(raw):
        exif = K.exif_year(F.lit("2019:07:01 10:00:00"), F.lit(None).cast("string"), F.lit(""))
        return one(spark, K.consistency(F.lit("Heavy rain lashes Mumbai 2024"), F.array(F.lit("Heavy rain lashes Mumbai")), F.lit(raw).cast("string"), F.lit("NO_MATCH_FOUND"), exif, F.lit("likely_authentic")))

    r = run(None)
    assert r["score"] == 0.78 and [f.split(":")[0] for f in r["flags"]] == ["OCR_TEXT_CONSISTENT"]
    r = run("In 2024 rain")
    assert r["score"] == 0.68 and [f.split(":")[0] for f in r["flags"]] == ["OCR_TEXT_CONSISTENT", "DATE_MISMATCH_CRITICAL"] and "by 5 years" in r["flags"][1]
    none = F.lit(None).cast("string")
    r = one(spark, K.consistency(none, F.array().cast("array<string>"), none, F.lit("VIRAL_RECIRCULATION"), F.lit(None).cast("int"), F.lit("LIKELY_AI_GENERATED")))
    assert r["score"] == 0.3 and [f.split(":")[0] for f in r["flags"]] == ["VIRAL_RECIRCULATION", "AI_GENERATED"]


@pytest.mark.parametrize(
    "claims,hits,s,c,evidence,status,confidence",
    [(0, 5, True, True, 5, "INSUFFICIENT_EVIDENCE", 0.55), (1, 0, False, False, 0, "UNVERIFIED", 0.55), (1, 3, True, False, 1, "SUPPORTED", 0.88), (1, 3, False, True, 1, "CONTRADICTED", 0.88), (1, 3, True, True, 2, "LIKELY_MISLEADING", 0.55), (1, 3, False, False, 1, "INSUFFICIENT_EVIDENCE", 0.55), (1, 3, False, False, 0, "UNVERIFIED", 0.55), (1, 3, None, None, None, "UNVERIFIED", 0.55)],
)
def test_verdict(spark, claims, hits, s, c, evidence, status, confidence):
    v = V.verdict(F.lit(claims), F.lit(hits), F.lit(s).cast("boolean"), F.lit(c).cast("boolean"), F.lit(evidence).cast("int"))
    assert one(spark, v) == status and one(spark, V.verdict_confidence(v)) == confidence


EVIDENCE = "submission_id int, claim_id int, document_id int, seq int, url string, domain string, source_type string, relationship string, support_score double, contradiction_score double, platform_label string, evidence_text string"


def evidence(spark):
    return spark.createDataFrame(
        [
            (1, 1, 1, 1, "u1", "b.com", "web", "SUPPORTS", 0.88, 0.0, None, "t1"), (1, 1, 2, 2, "u1", "b.com", "social_media", "CONTEXT", 0.0, 0.0, "Reddit", "t2"),
            (1, 2, 3, 3, "u2", "a.com", "web", "SUPPORTS", 0.88, 0.0, None, "t3"), (1, 2, 1, 4, "u3", "c.com", "news", "CONTRADICTS", 0.0, 0.9, None, "t4"), (2, 3, 9, 5, "u4", "d.com", "web", "CONTEXT", 0.0, 0.0, None, "t5"),
        ],
        EVIDENCE,
    )


def test_aggregates(spark):
    ev = evidence(spark)
    cl = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "submission_id int, claim_id int")
    assert {r["claim_id"]: r["verdict"] for r in V.claim_verdicts(cl, ev).collect()} == {1: "SUPPORTED", 2: "SUPPORTED", 3: "UNVERIFIED", 4: "UNVERIFIED"}
    subs = spark.createDataFrame([(1,), (2,), (3,)], "submission_id int")
    over = {r["submission_id"]: r["overall_status"] for r in V.overall_verdicts(subs, cl, cl.select("claim_id"), ev).collect()}
    assert over == {1: "LIKELY_MISLEADING", 2: "INSUFFICIENT_EVIDENCE", 3: "INSUFFICIENT_EVIDENCE"}
    cov = {r["submission_id"]: tuple(r)[1:] for r in V.coverage(ev).select("submission_id", "web_sources_checked", "social_sources_checked", "total_evidence_pieces", "independent_source_count").collect()}
    assert cov == {1: (2, 1, 3, 3), 2: (1, 0, 0, 1)}
    v = spark.createDataFrame([(1, "SUPPORTED", "POSSIBLY_MANIPULATED"), (2, "UNVERIFIED", None)], "submission_id int, overall_status string, image_verdict string")
    why = {r["submission_id"]: r["reason"] for r in V.reasons(v, ev).collect()}
    assert "including a.com, b.com." in why[1] and "digital editing" in why[1] and "tracked on Reddit with" in why[1] and why[2] == V.REASONS["OTHER"]
    ids = sorted((r["relationship"], r["ev_id"], r["evidence_text"]) for r in V.numbered_evidence(ev).collect())
    assert ids == [("CONTRADICTS", "ev-1", "t4"), ("SUPPORTS", "ev-1", "t1"), ("SUPPORTS", "ev-2", "t3")]
    assert sorted((r["url"], r["position"], r["source_type"]) for r in V.last_sources(ev).where("submission_id = 1").collect()) == [("u1", 1, "social_media"), ("u2", 2, "web"), ("u3", 3, "news")]


def test_graph(spark):
    g = V.edges(evidence(spark))
    assert g.count() == 5 and sorted((r["relationship_type"], r["weight"]) for r in g.distinct().collect())[-1] == ("SUPPORTS", 0.7)
    keys = {(r["submission_id"], r["node_key"]): r["label"] for r in V.nodes(g).collect()}
    assert keys[(1, "document:1")] == "document/1" and len(keys) == 5 + 2


def test_phash_matches_and_verdicts(spark):
    rows = [("a", "945a638b65a93eb2", 3), ("b", "945a638b65a93eb3", 1), ("c", "0000000000000000", 2), ("bad", "invalid!", 2), ("none", None, 2), ("a2", "945A638B65A93EB2", 9)]
    df = spark.createDataFrame(rows, "id string, phash string, created_at int")
    m = I.phash_matches(df)
    got = {(r["id"], r["match_id"]): (r["distance"], r["similarity_pct"], r["match_type"]) for r in m.collect()}
    assert got == {(x, y): (0, 100.0, "EXACT") if {x, y} == {"a", "a2"} else (1, 98.4, "NEAR_DUPLICATE") for x in ("a", "b", "a2") for y in ("a", "b", "a2") if x != y}
    v = {r["id"]: r for r in I.phash_verdicts(df, m).collect()}
    assert (v["a"]["match_verdict"], v["a"]["earliest_local_match"], v["a"]["first_created_at"]) == ("PREVIOUSLY_SEEN", 9, 1)
    assert (v["c"]["match_verdict"], v["c"]["risk_signal"]) == ("NO_MATCH_FOUND", False)
    sights = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["match_verdict"] for r in I.phash_verdicts(df, m, sights).collect()}["a"] == "VIRAL_RECIRCULATION"


def test_banded_matches_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20)
    vals = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 14)), replace=False))) for b in base for _ in range(10)]
    df = spark.createDataFrame([(i, format(v, "016x"), 1) for i, v in enumerate(vals)], "id int, phash string, created_at int")
    got = {(r["id"], r["match_id"]) for r in I.phash_matches(df).collect()}
    assert got == {(i, j) for i, x in enumerate(vals) for j, y in enumerate(vals) if i != j and bin(x ^ y).count("1") <= 10}


def test_near_bits_equal_all_pairs_in_small_steps(monkeypatch):
    monkeypatch.setattr(I, "CANDIDATES", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 60), np.zeros(40, np.int64)])  # zeros crowd a value of every piece
    y = np.concatenate([x[:50] ^ (1 << 63 - 3) ^ 5, rng.integers(0, 2**10, 60), -(1 << np.arange(0, 63, 4))])  # negative ones differ from 0 in many bits
    i, j = I.near_bits(x, y)
    assert list(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(x)) for b in range(len(y)) if bin((int(x[a]) ^ int(y[b])) & (2**64 - 1)).count("1") <= 10]
    assert [len(v) for v in I.near_bits(x[:0], y)] == [0, 0] == [len(v) for v in I.near_bits(x, y[:0])]


def test_blocks_of_hashes_equal_all_pairs_with_few_rows_shuffled(spark, monkeypatch):
    """A class goes to as many tasks as there are blocks, not to a row for each of 548 probes."""
    monkeypatch.setattr(I, "BLOCK", 32)
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 12)
    vals = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 14)), replace=False))) for b in base for _ in range(10)]
    df = spark.createDataFrame([(i, format(v % 2**64, "016x"), 1) for i, v in enumerate(vals)], "id int, phash string, created_at int")
    matches = I.phash_matches(df)
    got = [(r["id"], r["match_id"]) for r in matches.collect()]
    assert sorted(got) == [(i, j) for i, x in enumerate(vals) for j, y in enumerate(vals) if i != j and bin((x ^ y) % 2**64).count("1") <= 10]
    assert I.phash_matches(df.limit(0)).count() == 0


def test_reverse_queries_and_sightings(spark):
    q = one(spark, I.reverse_queries(F.lit("Heavy Rain Lashes Mumbai Traffic Disrupted Schools Remain Closed")))
    assert len(q) == 2 and "Mumbai" in q[0] and q[1].endswith("news report") and one(spark, I.reverse_queries(F.lit(None).cast("string"))) == []
    hits = [("i", "Heavy rain lashes Mumbai", 0, k, u, t, "") for k, (u, t) in enumerate([("u1", "rain, lashes town"), ("u2", "rain only"), ("u1", "rain lashes"), (None, "rain lashes mumbai")])]
    assert [r["url"] for r in I.web_sightings(spark.createDataFrame(hits, "id string, ocr_text string, q_ord int, hit_ord int, url string, title string, snippet string")).collect()] == ["u1"]


def test_uploads(spark):
    rej = lambda mime, data: one(spark, I.upload_reject(F.lit(mime), F.lit(bytearray(data)).cast("binary")))
    assert rej("image/jpeg", b"this is not an image") == "415:content" and rej("image/jpeg", b"\xff\xd8\xff\xe0") is None
    assert rej("text/plain", b"\xff\xd8\xff") == "415:type" and rej("image/webp", b"RIFF0000WEBP") is None and rej("image/png", b"") == "415:content"


def test_pixel_scores(spark):
    rng = np.random.default_rng(1)
    px = np.full((100, 100, 3), 255, np.uint8)
    px[20:80, 20:80] = 0
    px = np.clip(px.astype(int) - rng.integers(0, 50, px.shape), 0, 255).astype(np.uint8)
    df = spark.createDataFrame([("a", 100, 100, 3, bytearray(px.tobytes())), ("b", 10, 10, 3, bytearray(b"xx")), ("c", None, None, None, None)], "id string, height int, width int, nChannels int, data binary")
    got = {r["id"]: r for r in I.forensic_scores(df).collect()}
    assert all(0 <= got["a"][k] <= 1 for k in ("ela", "noise", "frequency", "copy_move"))
    assert got["b"]["image_type"] == got["c"]["image_type"] == "UNREADABLE" and got["c"]["noise"] == 0
    withjpeg = I.forensic_scores(df.where("id = 'a'"), saved=lambda p, q: p // 8 * 8).first()
    assert 0 <= withjpeg["ela"] <= 1
    assert I.image_type(np.zeros((200, 100, 3), np.uint8)) == "screenshot" and I.image_type(np.full((100, 100, 3), 250, np.uint8)) == "document" and I.image_type(np.zeros((100, 100, 3), np.uint8)) == "dark_mode_screenshot"
    assert I.frequency_score(np.zeros((100, 100))) == 0 and len(I.block_variances(np.zeros((40, 40)))) == 4


def test_ocr(spark):
    rows = [("i", "p", "v", " Mumbai  rain ", 0.9, 50.0, 11.9), ("i", "p", "v", "Heavy", 0.7, 10.0, 10.0), ("i", "p", "v", "second", 0.5, 5.0, 40.0), ("i", "p", "v", "95 %", 0.9, 1.0, 1.0), ("i", "p", "v", "5g", 0.9, 1.0, 1.0), ("i", "p", "v", "09:30 AM", 0.9, 1.0, 1.0), ("i", "p", "v", "x", 0.9, 1.0, 1.0), ("i", "p", "v", "7", 0.9, 1.0, 100.0), ("i", "q", "w", "हिन्दी", 0.95, 1.0, 1.0), ("j", "q", "w", None, 0.9, 1.0, 1.0)]
    r = O.regions(spark.createDataFrame(rows, "image_id string, engine string, variant string, text string, confidence double, center_x double, center_y double"))
    assert O.reading_order(r.where("engine = 'p'"), "image_id").first()["text"] == "Heavy Mumbai rain second 7"
    best = O.consensus(r).collect()
    assert len(best) == 1 and best[0]["engine_used"] == "q-w" and best[0]["has_devanagari"] and best[0]["overall_confidence"] == 0.95


def test_posts_and_articles(spark):
    meta = lambda t, d: f'<meta property="og:title" content="{t}"><meta content="{d}" property="og:description">'
    rows = [
        ("https://x.com/ann/status/1", meta("Ann on X: hey", "&quot;Big news&quot;"), "", "snip"), ("https://instagram.com/p/1", meta("Carol on Instagram: hi", "1,204 likes, 33 comments - Look at this"), "", ""), ("https://www.reddit.com/r/news/1", meta("Title", "A description that is long enough"), "old", ""),
        ("https://youtu.be/1", meta("Vid", "desc"), "", ""), ("https://x.com/bob/status/2", None, "t", "only a snippet"),
    ]
    got = {r["url"]: r for r in social.posts(spark.createDataFrame(rows, "url string, html string, title string, snippet string")).collect()}
    a, b, c, d, e = (got[r[0]] for r in rows)
    assert (a["author"], a["text"], a["platform_label"]) == ("Ann", '"Big news"', "X (Twitter)")  # the longer description wins over the text without quotes
    assert b["engagement_summary"] == "1,204 likes, 33 comments" and b["text"].endswith("Look at this")
    assert (c["title"], c["text"]) == ("Title", "Title. A description that is long enough") and c["author"] == "r/news" and d["text"] == "Vid - desc"
    assert (e["author"], e["text"], e["extracted_via"]) == ("@bob", "only a snippet", "snippet_fallback")
    pages = [("u", "<title> T &amp; U </title><article><p>" + "long text " * 20 + "</p></article>", "s"), ("v", "<p>tiny</p><p>" + "a paragraph of forty characters or more</p>", "s"), ("w", None, "s")]
    art = {r["url"]: r for r in social.articles(spark.createDataFrame(pages, "url string, html string, snippet string")).collect()}
    assert art["u"]["title"] == "T & U" and [art[k]["extracted_via"] for k in "uvw"] == ["article", "paragraphs", "snippet"] and art["w"]["text"] == "s"


def test_sentiment(spark):
    rec = spark.createDataFrame([("1", 0, "title", "As Trump Accuses Iran, He Has One Problem: His Own Credibility"), ("2", 1, "A great win", " ")], "id string, label int, title string, ocr_text string")
    got = {r["id"]: r for r in S.stage_one(rec).collect()}
    assert got["1"]["negative_words"] == ["accuses", "problem"] and got["1"]["positive_words"] == ["credibility"] and got["2"]["positive_words"] == ["great", "win"] and got["2"]["compound"] > 0


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0), (None, 1)], "t int, p int")
    r = V.evaluation(df, "t", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["accuracy"], r["f1"]) == (1, 1, 1, 2, 0.6, 0.5)
    assert V.evaluation(df.limit(0), "t", "p").first()["recall"] is None
