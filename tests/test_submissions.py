import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.plans.pipeline import run_pipeline
from evidentia.plans.queries import textured
from evidentia.sources.search import SearchProvider
from evidentia.streaming import submissions as S

CLAIM = "Government confirmed the climate bill in Paris on Monday."
ARTICLE = "Officials confirmed the climate bill in Paris today. The government said the climate bill in Paris is final. Data shows the bill passed. Nobody objected in the hall."
ROWS = [("a", CLAIM), ("b", "Government confirmed a warehouse fire in Mumbai on Monday."), ("c", ""), (None, CLAIM), ("d", "x" * 10_001), ("e", CLAIM + " POISON"), ("a", CLAIM + " again")]


class Fixed(SearchProvider):
    """One article and one that has nothing to do with it, for any query."""

    name = "fixed"

    def search(self, queries, num_results=5):
        hits = "inline(array(struct(1 as rank, 'https://bbc.com/1' as url, 'Government climate bill Paris' as title, 'confirmed' as snippet), struct(2 as rank, 'https://example.org/2' as url, 'Government confirmed' as title, 'Monday' as snippet)))"
        return queries.selectExpr("query_id", hits)


@pytest.fixture(scope="module")
def documents(spark):
    other = "Cooking rice takes patience and water. The soup was served warm in the kitchen of the old house. Dinner ended late."
    return spark.createDataFrame([(1, ARTICLE, "https://bbc.com/1", "t"), (2, other, "https://example.org/2", "t")], "doc_id long, text string, url string, title string")


def poisoned(subs, docs, provider):
    """The pipeline, which a text can break."""
    if subs.where("text like '%POISON%'").count():
        raise ValueError("poison\nin detail")
    return run_pipeline(subs, docs, provider)


def test_rejected_sources_and_whole_report(spark, documents):
    run = run_pipeline(spark.createDataFrame([("a", CLAIM)], "submission_id string, text string"), documents, Fixed())
    rejected = run.rejected.collect()
    assert {r["url"] for r in rejected} == {"https://example.org/2"} and all(r["evidence_text"].startswith("REJECTED: ") and r["relevance_score"] == 0 for r in rejected)
    assert run.evidence.where("relationship = 'REJECTED'").count() == 0
    report = json.loads(run.full_reports.first()["report"])["full_report"]
    assert [s["url"] for s in report["sources"]] == ["https://bbc.com/1", "https://example.org/2"]
    assert report["sources"][1]["evidence"].startswith("REJECTED: ") and report["independent_source_count"] == 2
    assert report["claims"][0]["verdict"] == report["overall_status"] == report["final"]["overall_status"] == "SUPPORTED"
    assert [e["id"] for e in report["supporting_evidence"]] == [f"ev-{i + 1}" for i in range(len(report["supporting_evidence"]))] and report["contradicting_evidence"] == []
    assert report["search_coverage"]["total_evidence_pieces"] == len(report["supporting_evidence"]) and report["timeline"] == [] and report["image_type_detected"] == "general"


def test_claims_that_fail_the_gate_are_shown(spark, documents):
    run = run_pipeline(spark.createDataFrame([("a", "TOP STORIES")], "submission_id string, text string"), documents, Fixed())
    claims = json.loads(run.full_reports.first()["report"])["full_report"]["claims"]
    assert all(c["status"] == "INVALID_CLAIM" and c["reason"] and "sources" not in c for c in claims)


def test_text_image_and_both(spark, documents):
    pictures = {i: textured(np.ones(3) * (i == "both"), 96, False) for i in ("image", "read", "both", "copy")}
    rows = [(i, 96, 96, 1, bytearray(p.tobytes())) for i, p in pictures.items()] + [("broken", 5, 5, 3, None)]
    images = spark.createDataFrame(rows, "submission_id string, height int, width int, nChannels int, data binary").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    subs = spark.createDataFrame([("text", CLAIM), ("image", None), ("read", ""), ("both", CLAIM), ("copy", None), ("broken", None)], "submission_id string, text string")

    def reader(px):
        return [(CLAIM, 0.9, 1.0, 1.0)] if px.mean() > 0 and abs(float(px.mean()) - float(pictures["both"].mean())) < 0.05 else []

    run = run_pipeline(subs, documents, Fixed(), images=images, engines={"reader": reader})
    got = {r["submission_id"]: json.loads(r["report"])["full_report"] for r in run.full_reports.collect()}
    assert set(got) == {"text", "image", "read", "both", "copy", "broken"}
    assert got["text"]["overall_status"] == got["both"]["overall_status"] == "SUPPORTED" and "image_verdict" not in got["text"]
    assert got["both"]["ocr"]["raw_text"] == CLAIM and got["both"]["multimodal_consistency"]["score"] > 0 and got["both"]["forensics"]["phash_match"]["match_verdict"] == "NO_MATCH_FOUND"
    assert got["image"]["overall_status"] == got["image"]["image_verdict"].upper() and got["image"]["forensics"]["phash_match"]["match_verdict"] == "PREVIOUSLY_SEEN"
    assert got["broken"]["image_type_detected"] == "UNREADABLE" and got["broken"]["claims"] == []


def test_stream_equals_batch_and_bad_rows_are_errors(spark, documents, tmp_path):
    path = str(tmp_path / "out")
    source = str(tmp_path / "in")
    df = spark.createDataFrame(ROWS, "submission_id string, text string").coalesce(1)
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    S.start(stream, path, documents, Fixed(), poisoned).awaitTermination()
    status = {r["submission_id"]: (r["status"], r["error_message"]) for r in S.poll(spark, path).collect()}
    assert status == {"a": ("complete", None), "b": ("complete", None), "c": ("error", "422:blank"), "d": ("error", "422:long"), "e": ("error", "ValueError: poison")}
    dead = sorted((r["submission_id"] or "", r["error_message"]) for r in S.dead_letters(spark, path).collect())
    assert dead == [("", S.NO_ID), ("a", S.REPEATED), ("c", "422:blank"), ("d", "422:long"), ("e", "ValueError: poison")]
    want = run_pipeline(spark.createDataFrame(ROWS[:2], "submission_id string, text string"), documents, Fixed()).full_reports
    assert sorted((r["submission_id"], r["report"]) for r in S.reports(spark, path).collect()) == sorted(map(tuple, want.collect()))


def test_restart_after_a_failure_doubles_nothing(spark, documents, tmp_path, monkeypatch):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    schema = "submission_id string, text string"
    spark.createDataFrame(ROWS[:2], schema).coalesce(1).write.parquet(source)
    whole, calls = S.read_status, []

    def failing(*a):
        calls.append(a)
        if len(calls) == 1:
            S.process_batch(spark.createDataFrame(ROWS[:1], schema), 0, path, documents, Fixed())  # an attempt that got as far as writing
            raise OSError("the driver is lost")
        return whole(*a)

    monkeypatch.setattr(S, "read_status", failing)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    with pytest.raises(Exception, match="driver is lost"):
        S.start(stream(), path, documents, Fixed()).awaitTermination()
    S.start(stream(), path, documents, Fixed()).awaitTermination()
    assert sorted(r["submission_id"] for r in S.reports(spark, path).collect()) == ["a", "b"]
    spark.createDataFrame([("a", "Another text of the same submission in Paris."), ("z", CLAIM)], schema).coalesce(1).write.mode("append").parquet(source)
    S.start(stream(), path, documents, Fixed()).awaitTermination()
    assert sorted(r["submission_id"] for r in S.reports(spark, path).collect()) == ["a", "b", "z"]
    assert {r["status"] for r in S.poll(spark, path).collect()} == {"complete"}


def test_halving_finds_the_bad_ones(spark):
    rows = spark.createDataFrame([(str(i), "t") for i in range(40)], "submission_id string, text string")
    runs = []

    def run(some):
        runs.append(1)
        if some.where("submission_id in ('7', '23')").count():
            raise KeyError("bad")
        return [some]

    done, failed = S.isolated(rows, run)
    assert sorted(r["submission_id"] for r in failed.collect()) == ["23", "7"]
    assert sorted(int(r["submission_id"]) for (part,) in done for r in part.collect()) == [i for i in range(40) if i not in (7, 23)]
    assert len(runs) < 45


def test_lists_of_a_report_come_from_one_shuffle(spark):
    """Texts of the evidence are dealt by submission once; null and repeated URLs, claims without evidence, evidence without a claim."""
    from evidentia.plans.full_report import full_reports

    claims = spark.createDataFrame([("s1", "c2", "B", "VALID", None, None), ("s1", "c1", "A", "INVALID_CLAIM", None, None), ("s1", None, "N", None, None, None), ("s2", "c3", "C", "VALID", None, ["q"])], "submission_id string, claim_id string, claim string, status string, reject_reason string, queries array<string>")
    rows = [("s1", "c2", "https://x.com/a/1", 3, "SUPPORTS", "X"), ("s1", "c2", "https://b.org", 1, "CONTRADICTS", None), ("s1", None, None, 2, "SUPPORTS", None), ("s1", "c2", "https://b.org", 5, "SUPPORTS", None), ("s1", "c2", None, 4, "NEUTRAL", None), ("s9", "c9", "u", 1, "SUPPORTS", None)]
    evidence = spark.createDataFrame([(s, c, None, u, f"text {n}", 0.0, 0.0, 0.5, "m", n, r, u, "web", p) for s, c, u, n, r, p in rows], "submission_id string, claim_id string, document_id string, url string, evidence_text string, support_score double, contradiction_score double, relevance_score double, retrieval_method string, seq int, relationship string, domain string, source_type string, platform_label string")
    verdicts = spark.createDataFrame([(s, "SUPPORTED", 0.9, None) for s in ("s1", "s2", "s3")], "submission_id string, overall_status string, confidence double, image_verdict string")
    reasons = verdicts.selectExpr("submission_id", "'because' AS reason")
    # as large tables, which aren't broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = full_reports(claims, evidence, verdicts, reasons)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3, "verdicts, reasons and the rows of the report"
        got = {r["submission_id"]: json.loads(r["report"])["full_report"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one = got["s1"]
    assert [(p["id"], p["evidence_text"]) for p in one["supporting_evidence"]] == [("ev-1", "text 2"), ("ev-2", "text 3"), ("ev-3", "text 5")] and [p["evidence_text"] for p in one["contradicting_evidence"]] == ["text 1"]
    assert [(s.get("url"), s["evidence"]) for s in one["sources"]] == [("https://b.org", "text 5"), (None, "text 4"), ("https://x.com/a/1", "text 3")]
    assert [p["post_text"] for p in one["social_media_evidence"]] == ["text 3"] and one["social_media_evidence"][0]["relevance"] == "SUPPORTS"
    assert [(c["claim_text"], c.get("verdict"), [s["evidence"] for s in c.get("sources", [])]) for c in one["claims"]] == [("N", "UNVERIFIED", []), ("A", None, []), ("B", "SUPPORTED", ["text 1", "text 3", "text 4", "text 5"])]
    assert [c["search_queries_json"] for c in got["s2"]["claims"]] == [["q"]] and got["s2"]["sources"] == [] and got["s3"]["claims"] == [] and set(got) == {"s1", "s2", "s3"}


def test_reports_in_place_equal_the_joined_ones(spark):
    """Verdict, reason and lists from rows that lie with their submission; hits that are no evidence, claims without hits, submissions without claims, rows of no submission."""
    from pyspark.sql import functions as F

    from evidentia.operators import verdicts as V
    from evidentia.plans.full_report import CLAIM, EVIDENCE, full_reports, reports_in_place

    claims = spark.createDataFrame([(s, c, f"text of {c}", k, None, None) for s, c, k in [("s1", "c1", "VALID"), ("s1", "c2", "INVALID_CLAIM"), ("s2", "c3", None), ("s3", "c4", "VALID"), ("s4", "c5", "VALID"), ("s6", "c6", "VALID"), (None, "c7", "VALID"), ("s9", "c8", "VALID")]], "submission_id string, claim_id string, claim string, status string, reject_reason string, queries array<string>")
    found = [("s1", "c1", 3, "SUPPORTS", "X"), ("s1", "c1", 1, "CONTRADICTS", None), ("s1", "c2", 2, "SUPPORTS", None), ("s2", "c3", 4, "SUPPORTS", None), ("s2", "c3", 5, None, "X"), ("s3", "c4", 6, "CONTRADICTS", None), ("s3", "c4", 7, "CONTRADICTS", None), ("s6", "c6", 8, "CONTEXT", "X"), (None, "c7", 9, "SUPPORTS", None), ("s9", "c8", 10, "SUPPORTS", None)]
    evidence = spark.createDataFrame([(s, c, None, f"https://d{n % 3}.org", f"text {n}", 0.0, 0.0, 0.5, "m", n, r, f"d{n % 3}.org", "web", p) for s, c, n, r, p in found], "submission_id string, claim_id string, document_id string, url string, evidence_text string, support_score double, contradiction_score double, relevance_score double, retrieval_method string, seq int, relationship string, domain string, source_type string, platform_label string")
    short = spark.createDataFrame([("s4", "c5"), ("s1", "c1")], "submission_id string, claim_id string")
    subs = spark.createDataFrame([(f"s{i}",) for i in range(1, 7)], "submission_id string")
    verdicts = V.overall_verdicts(subs, claims, evidence.select("claim_id").unionByName(short.select("claim_id")), evidence).withColumn("image_verdict", F.when(F.col("submission_id") == "s3", "LIKELY_AI_GENERATED"))
    want = {r["submission_id"]: json.loads(r["report"]) for r in full_reports(claims, evidence, verdicts, V.reasons(verdicts, evidence)).collect()}
    mark, rows = F.lit(True), lambda *dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(rows(*dfs[1:]), allowMissingColumns=True)
    union = rows(evidence.select("submission_id", "claim_id", F.struct(*EVIDENCE).alias("e"), mark.alias("hit")), short.withColumn("hit", mark), claims.select("submission_id", "claim_id", F.struct(*CLAIM).alias("c")), subs.withColumn("submitted", mark))
    got = reports_in_place(union.repartition(3, "submission_id"), F.when(F.col("submission_id") == "s3", "LIKELY_AI_GENERATED"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r["submission_id"]: json.loads(r["report"]) for r in got.collect()} == want and len(want) == 6
    assert len({x["full_report"]["overall_status"] for x in want.values()}) >= 5


def test_full_report_deals_keys_only(spark):
    """No text goes through a shuffle or into a table of its own."""
    from evidentia.plans.queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["full_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 3, "lineitem and orders by claim, then all rows by submission"
    below = plan[plan.index(dealt[0]) :]
    assert "evidence_text" not in below and "https://" not in below and "FileScan" in below and "FileScan" not in plan[: plan.index(dealt[0])]
