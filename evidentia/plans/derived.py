"""Domain inputs derived from the generated tables, as expressions that Spark SQL and DuckDB read alike.

The generated text holds no rule keywords, links or years, so rule operators
get sentences that are put together from key columns by fixed lists.
"""

from __future__ import annotations

SUBJECTS = ["Government", "President Smith", "The senator", "Reuters and Tesla", "Opposition party leaders", "MUMBAI police", "Elon Musk", "Officials of the Health Ministry", "Citizens", "A viral post", "Don't worry: she's told"]
VERBS = ["announced", "denied", "confirmed", "said", "rejects", "withheld", "claimed"]
OBJECTS = ["a nationwide 5G ban", "the climate bill in Paris", "a $5 billion factory in Texas by 2025", "new metro lines in New Delhi", "₹200 crore for the warehouse fire in sector 7"]
TAILS = ["", ".", " in 2019.", " on September 20, 2021.", "?", ", but critics called it fake news", " and nobody objected!!!!", " , while markets fell 3.5% today", " <b>now</b> see http://a.example/x", " mail me@b.example", " — sooooo  big", "\n\nMore follows...", " % $ = / ~"]
VIEWS = ["confirmed the", "officials denied", "a hoax says", "talks about", "alleged plans for", "video of the", "weather report on", "data shows", "stated again:"]
DOMAINS = ["www.altnews.in", "pib.gov.in", "www.cdc.gov", "bbc.com", "www.reddit.com/r/news", "netflix.com", "example.org", "x.com/alice/status", "mobile.twitter.com/bob", "www.instagram.com/p", "instagram.com/carol", "youtu.be", "www.youtube.com/@dave", "t.me", "news.thehindu.com:8080", "m.facebook.com"]
STATES = {"click": "queued", "view": "processing", "purchase": "complete", "error": "error"}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(key: str, options: list[str], literal: bool = True) -> str:
    cases = " ".join(f"WHEN {i} THEN {text(o) if literal else o}" for i, o in enumerate(options[:-1]))
    last = text(options[-1]) if literal else options[-1]
    return f"(CASE {key} % {len(options)} {cases} ELSE {last} END)"


def joined(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def claim(key: str) -> str:
    return joined(pick(key, SUBJECTS), "' '", pick(key, VERBS), "' '", pick(key, OBJECTS), pick(key, TAILS))


def evidence(key: str, claim_key: str) -> str:
    return joined(pick(key, VIEWS), "' '", pick(claim_key, OBJECTS), "' near '", pick(key, SUBJECTS), pick(key, TAILS))


def url(key: str) -> str:
    return joined("'https://'", pick(key, DOMAINS), "'/'", f"CAST({key} AS STRING)")


#: (claim_id, submission_id, claim, created_at)
CLAIMS = f"SELECT o_orderkey AS claim_id, o_custkey AS submission_id, {claim('o_orderkey')} AS claim, o_orderdate AS created_at FROM orders"
#: (claim_id, seq, document_id, source_id, url, evidence_text)
EVIDENCE = f"""SELECT l_orderkey AS claim_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, l_partkey AS document_id, l_suppkey AS source_id, {url('l_suppkey')} AS url,
  {evidence('(l_partkey + l_linenumber)', 'l_orderkey')} AS evidence_text, {claim('l_orderkey')} AS claim FROM lineitem"""
#: (key, event_id, status, ts)
LIFECYCLE = "SELECT user_id AS key, event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END AS status, ts FROM events WHERE event_type IN (" + ", ".join(f"'{k}'" for k in STATES) + ")"
