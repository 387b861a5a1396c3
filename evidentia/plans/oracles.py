"""The same queries in DuckDB SQL, over views of the same tables."""

from __future__ import annotations

from evidentia.functions import text as T
from evidentia.functions import urls as U
from evidentia.operators import claims as C
from evidentia.operators import consistency as K
from evidentia.operators import evidence as E
from evidentia.operators import graded
from evidentia.operators import sentiment as S
from evidentia.operators import verdicts as V
from evidentia.plans import derived as D
from evidentia.plans import queries as Q
from evidentia.sources.readers import I

ORACLES: dict[str, str] = {}
W = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(xs: list[str]) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w_: w_ <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{W}')"


def key_words(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda w_: length(w_) > 3)"


def to(x: str, n: int) -> str:
    return f"floor(({x}) * {10**n} + 0.5) / {float(10**n)}::DOUBLE"


def junk(s: str) -> str:
    return rf"(length({s}) < 20 OR starts_with(lower({s}), 'http') OR starts_with(lower({s}), 'source:') OR starts_with(lower({s}), 'www.') OR (contains(lower({s}), 'http') AND len({words(s)}) < 5))"


# --- retrieval

SENTENCES = rf"""
raw AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({strip("coalesce(text, '')")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda s: s <> '' AND NOT {junk('s')}) AS l FROM documents),
sents AS (SELECT doc_id, unnest(range(len(l)))::INT AS sent_ix, unnest(l) AS sentence FROM raw)"""
ORACLES["sentences_clean"] = f"WITH {SENTENCES} SELECT * FROM sents"

BM25 = rf"""{SENTENCES},
tok AS (SELECT doc_id, sent_ix, unnest({words('lower(sentence)')}) AS term FROM sents),
tf AS (SELECT doc_id, sent_ix, term, count(*) AS f FROM tok GROUP BY ALL),
sl AS (SELECT doc_id, sent_ix, sum(f) AS len FROM tf GROUP BY ALL),
dn AS (SELECT doc_id, count(*) AS n, avg(len) AS avgdl FROM sl GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT doc_id, term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df JOIN dn USING (doc_id)),
mean AS (SELECT doc_id, avg(idf) AS mean FROM idf GROUP BY ALL),
q AS (SELECT claim_id, term, count(*) AS qf FROM (SELECT item_id AS claim_id, unnest({words("lower(coalesce(text, ''))")}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
bm AS (SELECT claim_id, doc_id, sent_ix, {to("sum(qf * (CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)))", 6)} AS score
  FROM tf JOIN q USING (term) JOIN sl USING (doc_id, sent_ix) JOIN dn USING (doc_id) JOIN idf USING (doc_id, term) JOIN mean USING (doc_id) GROUP BY ALL)"""


def best(table: str, n: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY score DESC, sent_ix DESC)::INT AS rank FROM {table} WHERE score > 0 QUALIFY rank <= {n}"


ORACLES["bm25_top2"] = f"WITH {BM25} {best('bm', 2)}"
ORACLES["corpus_search"] = f"""WITH {BM25}, b AS (SELECT claim_id, doc_id, max(score) AS score FROM bm WHERE score > 0 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id)::INT AS rank FROM b QUALIFY rank <= 5"""


def index_words(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w_: NOT list_contains({arr(T.STOP)}, w_))"


TFIDF = rf"""
itok AS (SELECT doc_id, sent_ix, term, count(*) AS f FROM (SELECT doc_id, sent_ix, unnest({index_words('sentence')}) AS term FROM sents) GROUP BY ALL),
isz AS (SELECT doc_id, count(*) AS n FROM sents GROUP BY ALL),
idf1 AS (SELECT doc_id, term, count(*) AS df FROM itok GROUP BY ALL),
iq AS (SELECT claim_id, term, count(*) AS qf FROM (SELECT item_id AS claim_id, unnest({index_words("coalesce(text, '')")}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
pairs AS (SELECT DISTINCT claim_id, doc_id, sent_ix FROM itok JOIN iq USING (term)),
sv AS (SELECT p.claim_id, p.doc_id, p.sent_ix, t.term, t.f * (ln((2 + n)::DOUBLE / (1 + df + CASE WHEN iq.qf IS NULL THEN 0 ELSE 1 END)) + 1) AS w, iq.qf, n, df
  FROM pairs p JOIN itok t USING (doc_id, sent_ix) JOIN idf1 USING (doc_id, term) JOIN isz USING (doc_id) LEFT JOIN iq ON iq.claim_id = p.claim_id AND iq.term = t.term),
sa AS (SELECT claim_id, doc_id, sent_ix, sum(w * w) AS s2, sum(CASE WHEN qf IS NOT NULL THEN w * qf * (ln((2 + n)::DOUBLE / (2 + df)) + 1) END) AS dot FROM sv GROUP BY ALL),
cd AS (SELECT DISTINCT claim_id, doc_id FROM pairs),
cn AS (SELECT cd.claim_id, cd.doc_id, sum((iq.qf * (ln((2 + n)::DOUBLE / (2 + coalesce(df, 0))) + 1)) ** 2) AS c2 FROM cd JOIN iq USING (claim_id) JOIN isz USING (doc_id) LEFT JOIN idf1 ON idf1.doc_id = cd.doc_id AND idf1.term = iq.term GROUP BY ALL),
tf6 AS (SELECT claim_id, doc_id, sent_ix, {to('dot / sqrt(s2 * c2)', 6)} AS score FROM sa JOIN cn USING (claim_id, doc_id))"""
ORACLES["tfidf_top2"] = f"WITH {SENTENCES}, {TFIDF} {best('tf6', 2)}"
ORACLES["hybrid_rank"] = f"""WITH {BM25}, {TFIDF}, t AS ({best('tf6', 2)}), b AS ({best('bm', 2)}),
ts AS (SELECT claim_id, doc_id, sentence, arg_max(score, rank) AS tfidf_score, min(rank) AS t_rank, min(sent_ix) AS t_ix FROM t JOIN sents USING (doc_id, sent_ix) GROUP BY ALL),
bs AS (SELECT claim_id, doc_id, sentence, sum(score) AS bm25_score, min(rank) AS b_rank, min(sent_ix) AS b_ix FROM b JOIN sents USING (doc_id, sent_ix) GROUP BY ALL),
h AS (SELECT claim_id, doc_id, least(t_ix, b_ix) AS sent_ix, coalesce(tfidf_score, 0)::DOUBLE AS tfidf_score, coalesce(bm25_score, 0)::DOUBLE AS bm25_score,
  {to('0.4::DOUBLE * coalesce(tfidf_score, 0) + coalesce(bm25_score, 0)', 6)} AS combined, coalesce(t_rank, 1000 + b_rank) AS o FROM ts FULL JOIN bs USING (claim_id, doc_id, sentence))
SELECT * EXCLUDE (o), row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY combined DESC, o)::INT AS rank FROM h QUALIFY rank <= 2"""

# --- text

ORACLES["word_tokens"] = f"""SELECT doc_id, len({tokens("coalesce(text, '')")})::INT AS n_tokens, len(list_distinct({tokens("coalesce(text, '')")}))::INT AS n_distinct, len({key_words("coalesce(text, '')")})::INT AS n_key FROM documents"""


def overlap_words(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w_: length(w_) > 2 AND NOT list_contains({arr(T.OVERLAP_STOP)}, w_)))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


ORACLES["keyword_overlap"] = f"""WITH t AS (SELECT conv_id, turn, {overlap_words("coalesce(text, '')")} AS w FROM conversations)
SELECT a.conv_id, a.turn, {to(jaccard('a.w', 'b.w'), 6)} AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1"""

CLAIMS = f"claims AS ({D.CLAIMS})"
_norm = r"regexp_replace(claim, '[\x{200B}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
for _p, _r in ((r"<[^>]+>", " "), (r"https?://\S+", " "), (r"\S+@\S+", " "), (r"""[^\p{L}\p{N}_\s.,!?;:''"()\[\]{}&#%*+\-=/<>\x{20B9}$\x{20AC}\x{00A3}@]""", "")):
    _norm = f"regexp_replace({_norm}, '{_p}', '{_r}', 'g')"
for _p, _r in T.CONTRACTIONS.items():
    _norm = rf"regexp_replace({_norm}, '(?i)\b{_p.replace(chr(39), chr(39) * 2)}\b', '{_r}', 'g')"
_noise = r"((NOT regexp_matches(w_, '[\p{L}\p{N}]') AND w_ NOT IN ('%', '$', '₹', '€', '£', '+', '-')) OR (regexp_matches(w_, '^\p{L}$') AND lower(w_) NOT IN ('a', 'i')))"
ORACLES["normalize_core"] = rf"""WITH {CLAIMS}, n AS (SELECT claim_id, {_norm} AS c FROM claims)
SELECT claim_id, {strip(rf"regexp_replace(replace(array_to_string(list_filter({words('c')}, lambda w_: NOT {_noise}), ' '), '\n', ' '), '\s+', ' ', 'g')")} AS clean FROM n"""

_plain = rf"""list_filter(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w_: w_ <> ''), lambda v_: length(v_) > 1 AND NOT list_contains({arr(T.STOP)}, v_))"""
ORACLES["stage1_words"] = f"WITH t AS (SELECT conv_id, turn, {_plain} AS w FROM conversations) SELECT conv_id, turn, array_to_string(w, ' ') AS words, len(w)::INT AS n FROM t"

_years = r"regexp_extract_all({}, '\b(?:19|20)[0-9]{{2}}\b')"
ORACLES["numbers_years"] = rf"""WITH {CLAIMS} SELECT claim_id, array_to_string({_years.format('claim')}, ',') AS years, nullif(regexp_extract(claim, '\b(19[0-9][0-9]|20[0-3][0-9])\b', 1), '') AS query_year,
  array_to_string(regexp_extract_all(claim, '\b[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?\b'), '|') AS numbers, regexp_matches(claim, '[\x{{0900}}-\x{{097F}}]') AS devanagari FROM claims"""

_lex = ", ".join(f"({lit(w)}, {v}::DOUBLE)" for w, v in S.LEXICON.items())
ORACLES["sentiment_words"] = f"""WITH lex(word, valence) AS (VALUES {_lex}), w AS (SELECT doc_id, unnest({_plain}) AS word FROM documents),
m AS (SELECT doc_id, coalesce(valence, 0) AS v FROM w LEFT JOIN lex USING (word)),
s AS (SELECT doc_id, sum(v) AS t, count(*) FILTER (v / sqrt(v * v + 15) > 0.05) AS n_positive, count(*) FILTER (v / sqrt(v * v + 15) < -0.05) AS n_negative FROM m GROUP BY doc_id)
SELECT doc_id, n_positive, n_negative, {to('t / sqrt(t * t + 15)', 6)} AS compound FROM s"""

# --- claims

_reason = rf"""CASE WHEN len({words('claim')}) < 3 THEN 'Too few words to be a claim.'
  WHEN length(regexp_replace(claim, '[^\p{{L}}\p{{N}}_\x{{0900}}-\x{{097F}}]', '', 'g')) < 0.35::DOUBLE * length(claim) THEN 'Contains excessive non-alphanumeric noise.'
  WHEN list_contains({arr(C.LABELS)}, upper({strip('claim')})) THEN 'Appears to be a UI or navigation label.' END"""
ORACLES["claim_gate"] = f"""WITH {CLAIMS} SELECT claim_id, CASE WHEN ({_reason}) IS NULL THEN 'VALID' ELSE 'INVALID_CLAIM' END AS status, {_reason} AS reject_reason,
  {to(f"least(0.5::DOUBLE + CASE WHEN len({words('claim')}) > 6 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)", 2)} AS confidence FROM claims"""

_bare = r"regexp_replace(x_, '^[^\p{L}\p{N}$\x{20B9}]+|[^\p{L}\p{N}%]+$', '', 'g')"
ORACLES["query_generation"] = rf"""WITH {CLAIMS}, a AS (SELECT claim_id, {strip('claim')} AS c FROM claims), b AS (SELECT *, {words('c')} AS w FROM a),
k AS (SELECT *, list_filter(list_transform(w, lambda x_: {_bare}), lambda y_: length(y_) > 1 AND NOT list_contains({arr(T.STOP)}, lower(y_))) AS kept FROM b),
y AS (SELECT *, array_to_string(CASE WHEN len(kept) > 0 THEN kept[1:5] ELSE w[1:4] END, ' ') AS key, nullif(regexp_extract(c, '\b(19[0-9][0-9]|20[0-3][0-9])\b', 1), '') AS yr FROM k),
q AS (SELECT claim_id, list_filter([CASE WHEN len(w) BETWEEN 4 AND 7 AND NOT regexp_matches(c, '[^\p{{L}}\p{{N}}_\s\x{{0900}}-\x{{097F}}]') THEN '"' || c || '"' END,
   array_to_string(CASE WHEN len(kept) > 0 THEN kept[1:7] ELSE w[1:6] END, ' '), key || ' fact check', CASE WHEN key <> '' THEN '(site:x.com OR site:twitter.com) ' || key END,
   CASE WHEN key <> '' THEN '(site:instagram.com OR site:reddit.com) ' || key END, CASE WHEN yr IS NOT NULL THEN key || ' ' || yr END], lambda z_: z_ IS NOT NULL) AS l FROM y),
t AS (SELECT claim_id, list_transform(l, lambda z_: {strip('z_')}) AS l FROM q), u AS (SELECT claim_id, l, list_transform(l, lambda z_: lower(z_)) AS low FROM t),
f AS (SELECT claim_id, list_filter(list_filter(l, lambda z_, i_: z_ <> '' AND list_position(low, low[i_]) = i_)[1:5], lambda z_: length({strip('z_')}) >= 4) AS q FROM u),
r AS (SELECT claim_id, q, list_concat(list_filter(q, lambda z_: NOT (starts_with(z_, '(site:') OR starts_with(z_, 'site:')))[1:2], list_filter(q, lambda z_: starts_with(z_, '(site:') OR starts_with(z_, 'site:'))[1:2]) AS s FROM f)
SELECT claim_id, array_to_string(q, '|') AS queries, array_to_string(CASE WHEN len(s) > 0 THEN s ELSE q[1:3] END, '|') AS routed FROM r"""


# --- urls


def netloc(u: str) -> str:
    return rf"lower(coalesce(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), ''))"


def domain(u: str) -> str:
    return rf"regexp_replace({netloc(u)}, '^www\.', '')"


def any_of(test: str, xs: list[str]) -> str:
    return f"len(list_filter({arr(xs)}, lambda k_: {test})) > 0"


def source_type(u: str) -> str:
    d = domain(u)
    return f"""CASE WHEN coalesce({u}, '') = '' THEN 'unknown' WHEN {any_of(f'contains({d}, k_)', U.FACT_CHECKERS)} THEN 'fact_checker' WHEN {any_of(f'ends_with({d}, k_)', U.OFFICIAL_SUFFIXES)} THEN 'government'
  WHEN {any_of(f'contains({d}, k_)', U.NEWS)} THEN 'news' WHEN {any_of(f'contains({d}, k_)', U.SOCIAL_MATCH)} THEN 'social_media' ELSE 'web' END"""


def is_social(u: str) -> str:
    d = domain(u)
    return f"({d} <> '' AND {any_of(f'''{d} = k_ OR ends_with({d}, '.' || k_)''', list(U.SOCIAL_DOMAINS))})"


def platform(u: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({netloc(u)}, {lit(k)}) THEN {lit(v)}" for k, v in U.SOCIAL_DOMAINS.items()) + " END"


EVIDENCE = f"evidence AS MATERIALIZED ({D.EVIDENCE}), ev AS MATERIALIZED (SELECT *, {is_social('url')} AS is_social FROM evidence)"
ORACLES["source_quality"] = f"""WITH {EVIDENCE}, s AS (SELECT seq, url, {source_type('url')} AS source_type FROM evidence)
SELECT seq, source_type, CASE source_type WHEN 'unknown' THEN 0.1 WHEN 'fact_checker' THEN 0.95 WHEN 'government' THEN 1.0 WHEN 'news' THEN 0.85 WHEN 'social_media' THEN 0.45 ELSE 0.55 END::DOUBLE AS authority,
  {domain('url')} AS domain, {netloc('url')} AS netloc, split_part(url, '/', 3) AS host FROM s"""
_parts = r"list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p_: p_ <> '')"
ORACLES["social_urls"] = f"""WITH {EVIDENCE}, p AS (SELECT seq, is_social, {platform('url')} AS platform, {_parts} AS l FROM ev)
SELECT seq, is_social, platform, coalesce(CASE WHEN platform = 'x' THEN '@' || l[1] WHEN platform = 'instagram' AND l[1] NOT IN ('p', 'reel', 'stories') THEN '@' || l[1]
  WHEN platform = 'reddit' AND l[1] = 'r' THEN 'r/' || l[2] WHEN platform = 'youtube' AND starts_with(l[1], '@') THEN l[1] END, '') AS author FROM p"""

# --- evidence

_c, _e, _low = "coalesce(claim, '')", "coalesce(evidence_text, '')", "lower(coalesce(evidence_text, ''))"
TOK = f"""tk AS MATERIALIZED (SELECT *, {key_words(_c)} AS own, list_distinct({tokens(_e)}) AS there, {_low} AS low FROM ev),
tm AS MATERIALIZED (SELECT *, len(list_filter(own, lambda w_: list_contains(there, w_))) AS overlap, len(list_intersect(list_distinct(own), there)) AS shared, len(list_distinct(own)) AS n_own, len(list_filter(own, lambda w_: contains(low, w_))) AS inside FROM tk)"""
_ratio = "(CASE WHEN n_own > 0 THEN shared::DOUBLE / n_own ELSE 1.0::DOUBLE END)"
_rel = [
    (f"{_c} = '' OR {_e} = ''", "false", "0.0", lit(E.REASONS["empty"])),
    (f"is_social AND length({strip(_e)}) < 20", "false", "0.1", lit(E.REASONS["short"])),
    ("is_social AND (inside >= 1 OR len(own) <= 2)", "true", "0.75", lit(E.REASONS["social"])),
    (f"{_ratio} < 0.18 AND shared < 2", "false", _ratio, lit(E.REASONS["overlap"])),
    ("true", "true", f"least({_ratio} + 0.3::DOUBLE, 1.0)", lit(E.REASONS["fit"])),
]


def chain(rules: list[tuple], i: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rules) + " END"


ORACLES["relevance"] = f"WITH {EVIDENCE}, {TOK} SELECT seq, {chain(_rel, 1)} AS relevant, {to(f'({chain(_rel, 2)})::DOUBLE', 6)} AS score, {chain(_rel, 3)} AS reason FROM tm"


def has(ks: list[str]) -> str:
    return any_of("contains(low, k_)", ks)


_refuted = f"'The source explicitly refutes the claim using terms such as ''' || array_to_string(list_filter({arr(E.CONTRADICTION)}, lambda k_: contains(low, k_))[1:2], ', ') || '''.'"
_num = f"len(list_intersect(regexp_extract_all({_c}, '[0-9]+'), regexp_extract_all({_e}, '[0-9]+'))) > 0"
_cls = [
    (f"{_c} = '' OR {_e} = ''", lit("IRRELEVANT"), "false", "0.0", lit(E.REASONS["none"])),
    ("overlap < 1 AND NOT is_social", lit("IRRELEVANT"), "false", "0.85", lit(E.REASONS["irrelevant"])),
    ("against", lit("CONTRADICTS"), "alleged", "0.90", _refuted),
    (f"is_social AND (alleged OR {has(E.VIRAL)})", lit("SOCIAL_VIRAL_POST"), "true", "0.80", lit(E.REASONS["viral"])),
    ("is_social", lit("CONTEXT"), "false", "0.65", lit(E.REASONS["talk"])),
    ("alleged AND NOT support", lit("ATTRIBUTED_CLAIM"), "true", "0.82", lit(E.REASONS["attributed"])),
    (f"support OR overlap >= 3 OR {_num} OR (contains({_c}, '₹') AND contains({_e}, '₹'))", lit("SUPPORTS"), "false", "0.88", lit(E.REASONS["support"])),
    ("true", lit("CONTEXT"), "alleged", "0.60", lit(E.REASONS["context"])),
]
FLAGS = f"fl AS MATERIALIZED (SELECT *, {has(E.ATTRIBUTION)} AS alleged, {has(E.CONTRADICTION)} AS against, {has(E.SUPPORT)} AS support FROM tm)"
ORACLES["classify_evidence"] = f"WITH {EVIDENCE}, {TOK}, {FLAGS} SELECT seq, {chain(_cls, 1)} AS relationship, {chain(_cls, 2)} AS is_allegation, ({chain(_cls, 3)})::DOUBLE AS confidence, {chain(_cls, 4)} AS reason FROM fl"
_label = "CASE " + " ".join(f"WHEN p_ = {lit(k)} THEN {lit(v)}" for k, v in U.PLATFORM_LABELS.items()) + " ELSE 'Social' END"
CLASSIFIED = f"""{EVIDENCE}, {TOK}, {FLAGS}, {CLAIMS},
ce AS (SELECT *, {chain(_cls, 1)} AS relationship, ({chain(_cls, 3)})::DOUBLE AS sure, {platform('url')} AS p_ FROM fl WHERE length({strip(_e)}) >= CASE WHEN is_social THEN 20 ELSE 50 END),
cl AS MATERIALIZED (SELECT submission_id, ce.claim_id, seq, document_id, source_id, url, substring(evidence_text, 1, 500) AS evidence_text, CASE WHEN relationship = 'SUPPORTS' THEN sure ELSE 0.0 END::DOUBLE AS support_score,
  CASE WHEN relationship = 'CONTRADICTS' THEN sure ELSE 0.0 END::DOUBLE AS contradiction_score, CASE WHEN is_social THEN 0.85 ELSE 1.0 END::DOUBLE AS relevance_score,
  CASE WHEN is_social THEN 'social_media_search' ELSE 'bm25+tfidf' END AS retrieval_method, relationship, split_part(url, '/', 3) AS domain, {source_type('url')} AS source_type, CASE WHEN is_social THEN {_label} END AS platform_label
  FROM ce JOIN claims c ON c.claim_id = ce.claim_id)"""
ORACLES["evidence_scores"] = f"WITH {CLASSIFIED} SELECT seq, support_score, contradiction_score, relevance_score, retrieval_method, evidence_text FROM cl"
ORACLES["claim_verdict"] = f"""WITH {CLASSIFIED}, f AS (SELECT claim_id, bool_or(relationship = 'SUPPORTS') AS s, bool_or(relationship = 'CONTRADICTS') AS c FROM cl GROUP BY claim_id)
SELECT submission_id, claims.claim_id, CASE WHEN s THEN 'SUPPORTED' WHEN c THEN 'CONTRADICTED' ELSE 'UNVERIFIED' END AS verdict FROM claims LEFT JOIN f ON f.claim_id = claims.claim_id"""
OVERALL = f"""{CLASSIFIED}, nc AS (SELECT submission_id, count(*) AS n_claims FROM claims GROUP BY ALL),
nh AS (SELECT submission_id, count(*) AS n_hits FROM lineitem JOIN claims ON l_orderkey = claim_id GROUP BY ALL),
ne AS (SELECT submission_id, count(*) AS n_evidence, bool_or(relationship = 'SUPPORTS') AS s, bool_or(relationship = 'CONTRADICTS') AS c FROM cl GROUP BY ALL),
ov AS (SELECT c_custkey AS submission_id, coalesce(n_claims, 0) AS n_claims, coalesce(n_hits, 0) AS n_hits, coalesce(n_evidence, 0) AS n_evidence, CASE WHEN coalesce(n_claims, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN coalesce(n_hits, 0) = 0 THEN 'UNVERIFIED'
  WHEN coalesce(s, false) AND NOT coalesce(c, false) THEN 'SUPPORTED' WHEN coalesce(c, false) AND NOT coalesce(s, false) THEN 'CONTRADICTED' WHEN s AND c THEN 'LIKELY_MISLEADING' WHEN coalesce(n_evidence, 0) > 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'UNVERIFIED' END AS overall_status
  FROM customer LEFT JOIN nc ON nc.submission_id = c_custkey LEFT JOIN nh ON nh.submission_id = c_custkey LEFT JOIN ne ON ne.submission_id = c_custkey)"""
ORACLES["overall_verdict"] = f"WITH {OVERALL} SELECT *, CASE WHEN overall_status IN ('SUPPORTED', 'CONTRADICTED') THEN 0.88 ELSE 0.55 END::DOUBLE AS confidence FROM ov"
COVER = """lastu AS (SELECT submission_id, url, arg_max(source_type, seq) AS t FROM cl GROUP BY ALL), web AS (SELECT submission_id, count(*) FILTER (t <> 'social_media') AS web_sources_checked, count(url) AS independent_source_count FROM lastu GROUP BY ALL),
cov AS (SELECT submission_id, count(*) FILTER (source_type = 'social_media') AS social_sources_checked, count(*) FILTER (relationship IN ('SUPPORTS', 'CONTRADICTS')) AS total_evidence_pieces FROM cl GROUP BY ALL)"""
ORACLES["coverage"] = f"WITH {CLASSIFIED}, {COVER} SELECT * FROM cov JOIN web USING (submission_id)"
_three = "coalesce(array_to_string(list_sort(list_distinct(list(domain) FILTER (relationship = '{}')))[1:3], ', '), '')"
REASON = f"""sets AS (SELECT submission_id, {_three.format('SUPPORTS')} AS pro, {_three.format('CONTRADICTS')} AS con, coalesce(array_to_string(list_sort(list_distinct(list(platform_label) FILTER (platform_label IS NOT NULL))), ', '), '') AS social FROM cl GROUP BY submission_id),
re AS (SELECT ov.submission_id, {D.pick('ov.submission_id', Q.LABELS)} AS image_verdict, overall_status, pro, con, social FROM ov LEFT JOIN sets USING (submission_id)),
rs AS (SELECT submission_id, concat_ws(' ', CASE overall_status WHEN 'SUPPORTED' THEN {lit(V.REASONS['SUPPORTED'])} WHEN 'CONTRADICTED' THEN {lit(V.REASONS['CONTRADICTED'])} WHEN 'LIKELY_MISLEADING' THEN {lit(V.REASONS['LIKELY_MISLEADING'])} ELSE {lit(V.REASONS['OTHER'])} END,
  CASE WHEN overall_status = 'SUPPORTED' AND coalesce(pro, '') <> '' THEN 'Supporting articles were verified on domains including ' || pro || '.' END,
  CASE WHEN overall_status = 'CONTRADICTED' AND coalesce(con, '') <> '' THEN 'Contradictory findings were published on ' || con || '.' END,
  CASE image_verdict WHEN 'LIKELY_AI_GENERATED' THEN {lit(V.REASONS['LIKELY_AI_GENERATED'])} WHEN 'POSSIBLY_MANIPULATED' THEN {lit(V.REASONS['POSSIBLY_MANIPULATED'])} END,
  CASE WHEN coalesce(social, '') <> '' THEN 'Social media activity was also tracked on ' || social || ' with active public discussion.' END) AS reason FROM re)"""
ORACLES["reason_text"] = f"WITH {OVERALL}, {REASON} SELECT * FROM rs"
ORACLES["report_json"] = f"""WITH {OVERALL}, {REASON}, {COVER} SELECT ov.submission_id, overall_status, reason AS summary, web_sources_checked AS web, independent_source_count AS sources
FROM ov JOIN rs USING (submission_id) LEFT JOIN web USING (submission_id)"""
ORACLES["full_report"] = f"""WITH {OVERALL}, {REASON}, {COVER},
vc AS (SELECT claim_id, bool_or(relationship = 'SUPPORTS') AS s, bool_or(relationship = 'CONTRADICTS') AS c, count(*) AS n FROM cl GROUP BY claim_id),
c1 AS (SELECT submission_id, string_agg(claims.claim_id::VARCHAR, '|' ORDER BY claims.claim_id) AS claim_ids, md5(string_agg(claim, '|' ORDER BY claims.claim_id)) AS claims_md5,
  string_agg(CASE WHEN s THEN 'SUPPORTED' WHEN c THEN 'CONTRADICTED' ELSE 'UNVERIFIED' END, '|' ORDER BY claims.claim_id) AS claim_verdicts, sum(coalesce(n, 0))::BIGINT AS n_claim_sources FROM claims LEFT JOIN vc ON vc.claim_id = claims.claim_id GROUP BY submission_id),
s1 AS (SELECT submission_id, string_agg('ev-' || i, '|' ORDER BY i) AS support_ids, string_agg(claim_id::VARCHAR, '|' ORDER BY i) AS support_claims FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY seq) AS i FROM cl WHERE relationship = 'SUPPORTS') GROUP BY submission_id),
k1 AS (SELECT submission_id, count(*) AS n_contradicting FROM cl WHERE relationship = 'CONTRADICTS' GROUP BY submission_id),
u1 AS (SELECT submission_id, string_agg(url, '|' ORDER BY f) AS urls, string_agg(t, '|' ORDER BY f) AS source_types FROM (SELECT submission_id, url, arg_max(source_type, seq) AS t, min(seq) AS f FROM cl GROUP BY ALL) GROUP BY submission_id),
p1 AS (SELECT submission_id, string_agg(platform_label, '|' ORDER BY seq) AS platforms, string_agg(relationship, '|' ORDER BY seq) AS relevances, count(*) AS n_posts FROM cl WHERE platform_label IS NOT NULL GROUP BY submission_id)
SELECT ov.submission_id, ov.overall_status, CASE WHEN ov.overall_status IN ('SUPPORTED', 'CONTRADICTED') THEN 0.88 ELSE 0.55 END::DOUBLE AS confidence, reason AS summary, coalesce(claim_ids, '') AS claim_ids, coalesce(claims_md5, md5('')) AS claims_md5,
  coalesce(claim_verdicts, '') AS claim_verdicts, coalesce(n_claim_sources, 0) AS n_claim_sources, coalesce(support_ids, '') AS support_ids, coalesce(support_claims, '') AS support_claims, coalesce(n_contradicting, 0) AS n_contradicting,
  coalesce(urls, '') AS urls, coalesce(source_types, '') AS source_types, coalesce(platforms, '') AS platforms, coalesce(relevances, '') AS relevances, coalesce(web_sources_checked, 0) AS web, coalesce(n_posts, 0) AS social,
  coalesce(total_evidence_pieces, 0) AS pieces, coalesce(independent_source_count, 0) AS n_sources, 'general' AS image_type_detected, image_verdict
FROM ov JOIN rs USING (submission_id) JOIN (SELECT submission_id, image_verdict FROM re) USING (submission_id) LEFT JOIN c1 USING (submission_id) LEFT JOIN s1 USING (submission_id) LEFT JOIN k1 USING (submission_id)
LEFT JOIN u1 USING (submission_id) LEFT JOIN p1 USING (submission_id) LEFT JOIN web USING (submission_id) LEFT JOIN cov USING (submission_id)"""
EDGES = """ed AS (SELECT submission_id, 'claim' AS from_node_type, claim_id::VARCHAR AS from_node_id, 'document' AS to_node_type, document_id::VARCHAR AS to_node_id,
  CASE WHEN support_score > 0.5 THEN 'SUPPORTS' WHEN contradiction_score > 0.5 THEN 'CONTRADICTS' ELSE 'CONTEXT' END AS relationship_type, CASE WHEN support_score > 0.5 THEN 0.7 WHEN contradiction_score > 0.5 THEN 0.9 ELSE 0.4 END::DOUBLE AS weight FROM cl)"""
ORACLES["evidence_edges"] = f"WITH {CLASSIFIED}, {EDGES} SELECT * FROM ed"
ORACLES["graph_nodes"] = f"""WITH {CLASSIFIED}, {EDGES}, n AS (SELECT submission_id, from_node_type AS t, from_node_id AS i FROM ed UNION SELECT submission_id, to_node_type, to_node_id FROM ed)
SELECT submission_id, t || ':' || i AS node_key, t AS node_type, t || '/' || substring(i, 1, 8) AS label FROM n"""
ORACLES["numbered_evidence"] = f"""WITH {CLASSIFIED} SELECT submission_id, relationship, 'ev-' || row_number() OVER (PARTITION BY submission_id, relationship ORDER BY seq) AS ev_id, claim_id, evidence_text,
  CASE WHEN relationship = 'SUPPORTS' THEN 0.88 ELSE 0.0 END::DOUBLE AS support_score, CASE WHEN relationship = 'SUPPORTS' THEN 0.0 ELSE 0.9 END::DOUBLE AS contradiction_score FROM cl WHERE relationship IN ('SUPPORTS', 'CONTRADICTS')"""
ORACLES["last_sources"] = f"""WITH {CLASSIFIED}, u AS (SELECT submission_id, url, arg_max(source_type, seq) AS source_type, arg_max(relationship, seq) AS relationship, min(seq) AS f FROM cl GROUP BY ALL)
SELECT submission_id, url, source_type, relationship, row_number() OVER (PARTITION BY submission_id ORDER BY f)::INT AS position FROM u"""

ORACLES["graded_verdicts"] = """WITH v AS (SELECT l_discount * 10 AS s, l_tax * 12.5::DOUBLE AS c, l_linenumber % 4 AS ind, (l_quantity % 7)::INT AS pieces, l_quantity / 50 AS cov, l_suppkey % 5 = 0 AS differs FROM lineitem),
w AS (SELECT *, (CASE WHEN c >= 0.6 THEN 1 ELSE 0 END) + (CASE WHEN cov >= 0.6 THEN 1 ELSE 0 END) AS strong FROM v)
SELECT CASE WHEN pieces < 2 OR cov < 0.2 THEN 'INSUFFICIENT_EVIDENCE' WHEN s >= 0.75 AND c < 0.2 AND ind >= 2 AND NOT differs THEN 'SUPPORTED' WHEN s >= 0.55 AND c < 0.3 AND NOT differs THEN 'LIKELY_SUPPORTED' WHEN s >= 0.35 AND c < 0.4 AND NOT differs THEN 'PARTIALLY_SUPPORTED'
    WHEN s >= 0.3 AND differs THEN 'MISLEADING_CONTEXT' WHEN c >= 0.65 AND ind >= 2 THEN 'CONTRADICTED' WHEN c >= 0.4 THEN 'UNSUPPORTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS claim_verdict,
  CASE WHEN s >= 0.75 THEN 'LIKELY_AI_GENERATED' WHEN s >= 0.55 AND s >= 0.6 THEN 'POSSIBLY_AI_GENERATED' WHEN strong >= 2 OR c >= 0.75 THEN 'LIKELY_MANIPULATED' WHEN strong = 1 THEN 'POSSIBLY_MANIPULATED' WHEN s < 0.2 AND c < 0.2 AND cov < 0.2 THEN 'LIKELY_AUTHENTIC'
    WHEN s < 0.35 AND greatest(c, cov, 0.1) < 0.35 THEN 'POSSIBLY_AUTHENTIC' ELSE 'INCONCLUSIVE' END AS image_verdict, count(*) AS n FROM w GROUP BY ALL"""
_types = "CASE t " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in graded.TYPE_SCORES.items()) + " ELSE 0 END"
ORACLES["quality_scores"] = f"""WITH {EVIDENCE}, s AS (SELECT seq, {source_type('url')} AS t, document_id, source_id FROM evidence),
p AS (SELECT seq, CASE t WHEN 'unknown' THEN 0.1 WHEN 'fact_checker' THEN 0.95 WHEN 'government' THEN 1.0 WHEN 'news' THEN 0.85 WHEN 'social_media' THEN 0.45 ELSE 0.55 END::DOUBLE AS a, ({_types})::DOUBLE AS ty, pow(0.5::DOUBLE, (document_id % 900)::DOUBLE / 365.0::DOUBLE) AS r,
  least((source_id % 11) / 10.0::DOUBLE, 1.0) AS d, (document_id % 4) / 3.0::DOUBLE AS k FROM s)
SELECT seq, {to('a', 4)} AS authority, {to('ty', 4)} AS type, {to('r', 4)} AS recency, {to('d', 4)} AS directness, {to('k', 4)} AS corroboration, {to('0.0::DOUBLE + a * 0.3::DOUBLE + ty * 0.2::DOUBLE + r * 0.15::DOUBLE + d * 0.2::DOUBLE + k * 0.15::DOUBLE', 4)} AS score FROM p"""
ORACLES["independent_origins"] = f"""WITH {CLASSIFIED}, g AS (SELECT submission_id, array_to_string({tokens('evidence_text')}, ' ') AS origin, count(DISTINCT domain) AS domains FROM cl GROUP BY ALL)
SELECT submission_id, count(*) AS independent_source_count, count(*) FILTER (domains > 1) AS duplicate_source_group_count FROM g GROUP BY submission_id"""

# --- reads

ORACLES["sources_of"] = f"""WITH {EVIDENCE}, {CLAIMS} SELECT DISTINCT submission_id, d.source_id, s_name AS name FROM evidence JOIN claims USING (claim_id)
JOIN (SELECT DISTINCT l_partkey AS document_id, l_suppkey AS source_id FROM lineitem) d USING (document_id) JOIN supplier ON s_suppkey = d.source_id"""
ORACLES["evidence_of"] = f"WITH {EVIDENCE}, {CLAIMS} SELECT seq, claim_id, document_id, url FROM evidence WHERE claim_id IN (SELECT claim_id FROM claims)"
ORACLES["timeline_of"] = "SELECT o_custkey AS submission_id, o_orderkey AS event_id, strftime(o_orderdate, '%Y-%m-%d') AS event_date, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)::INT AS position FROM orders"
ORACLES["content_dedup"] = "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1"
ORACLES["source_upsert"] = f"""WITH p AS (SELECT url, page_id AS seq, {source_type('url')} AS source_type FROM pages), k AS (SELECT url, min(source_type) AS source_type, min(seq) AS first_page FROM p WHERE seq % 2 = 0 GROUP BY url)
SELECT * FROM k UNION ALL SELECT url, arg_min(source_type, seq), min(seq) FROM p WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM k) GROUP BY url"""
ORACLES["cache_keys"] = f"WITH {CLAIMS} SELECT claim_id, sha256('corpus:' || lower({strip('claim')})) AS key, sha256(claim) AS content_hash FROM claims"
_rate = "CASE WHEN {1} > 0 THEN ({0})::DOUBLE / ({1}) END"
_neg = [w for w, v in S.LEXICON.items() if v / (v * v + 15) ** 0.5 < -0.05]
ORACLES["eval_metrics"] = f"""WITH p AS (SELECT doc_id, len(list_filter({_plain}, lambda n_: list_contains({arr(_neg)}, n_))) > 0 AS p FROM documents),
c AS (SELECT count(*) FILTER (toxic = 1 AND p) AS tp, count(*) FILTER (toxic <> 1 AND p) AS fp, count(*) FILTER (toxic = 1 AND NOT p) AS fn, count(*) FILTER (toxic <> 1 AND NOT p) AS tn FROM labels JOIN p USING (doc_id) WHERE toxic IS NOT NULL)
SELECT tp, fp, fn, tn, {_rate.format('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_rate.format('tp', '(tp + fp)')} AS precision, {_rate.format('tp', '(tp + fn)')} AS recall, {_rate.format('2 * tp', '(2 * tp + fp + fn)')} AS f1,
  {_rate.format('fp', '(fp + tn)')} AS fpr, {_rate.format('fn', '(fn + tp)')} AS fnr FROM c"""

# --- pages and requests


def unescape(x: str) -> str:
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def strip_tags(x: str) -> str:
    bare = rf"regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    return collapse(unescape(rf"regexp_replace({bare}, '(?s)<[^>]+>', ' ', 'g')"))


PAGES = rf"""pg AS (SELECT page_id, url, {collapse(unescape("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
  {strip_tags("regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*?)</article>', 1)")} AS body,
  array_to_string(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda p_: {strip_tags('p_')}), lambda p_: length(p_) > 30)[1:10], ' ') AS ps FROM pages)"""
ORACLES["article_text"] = f"""WITH {PAGES} SELECT page_id, title, CASE WHEN length(body) >= 80 THEN body WHEN ps <> '' THEN ps ELSE 'no text' END AS text, CASE WHEN length(body) >= 80 THEN 'article' WHEN ps <> '' THEN 'paragraphs' ELSE 'snippet' END AS extracted_via FROM pg"""
ORACLES["hit_accept_rank"] = f"""WITH {PAGES}, n AS (SELECT count(*) AS n FROM benchmark), h AS (SELECT page_id AS hit_ord, url, title || ' ' || substring(ps, 1, 300) AS shown, page_id % n AS claim_id FROM pg, n),
j AS (SELECT h.*, list_distinct({key_words("coalesce(b.text, '')")}) AS own, list_distinct({key_words('shown')}) AS found FROM h JOIN benchmark b ON b.item_id = h.claim_id),
k AS (SELECT claim_id, url, q_ord, hit_ord FROM j, (VALUES (0), (1)) q(q_ord) WHERE coalesce(url, '') <> '' AND ({is_social('url')} OR len(own) = 0 OR len(list_intersect(own, found)) >= 1)),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY claim_id, url ORDER BY q_ord, hit_ord) = 1)
SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY q_ord, hit_ord, url)::INT AS rank FROM f"""
ORACLES["submissions_intake"] = rf"""WITH {CLAIMS}, r AS (SELECT claim_id AS id, CASE claim_id % 5 WHEN 0 THEN ' String ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE claim END AS t, claim_id % 3 = 0 AS img FROM claims),
s AS (SELECT id, img, CASE WHEN lower({strip("coalesce(t, '')")}) = 'string' THEN '' ELSE {strip("coalesce(t, '')")} END AS t FROM r),
k AS (SELECT id, CASE WHEN t <> '' AND img THEN 'multimodal' WHEN img THEN 'image' WHEN t <> '' THEN 'text' END AS input_type FROM s)
SELECT id, input_type, CASE WHEN input_type IS NULL THEN '422:empty' END AS reject, CASE WHEN input_type IS NOT NULL THEN 'queued' END AS status FROM k"""
ORACLES["request_checks"] = f"""SELECT doc_id, CASE WHEN {strip("coalesce(text, '')")} = '' THEN '422:blank' WHEN length(text) > 10000 THEN '422:long' END AS reject, greatest(1, least(20, (doc_id % 30 - 3)::INT)) AS page_size FROM documents"""

# --- images

PICS = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, v, list_sum(v) / len(v) AS mean FROM e),
b AS (SELECT id, list_transform(v, lambda x_: CASE WHEN x_ > mean THEN 1 ELSE 0 END) AS b, 1700000000 + id * 60 AS seen FROM m),
base AS (SELECT id, array_to_string(list_transform(range(0, 16), lambda i_: substring('0123456789abcdef', (b[i_ * 4 + 1] * 8 + b[i_ * 4 + 2] * 4 + b[i_ * 4 + 3] * 2 + b[i_ * 4 + 4] + 1)::INT, 1)), '') AS phash, seen FROM b),
bits AS (SELECT id, phash, ('0x' || phash)::UBIGINT AS bits, seen FROM base),
pics AS (SELECT id, bits, seen FROM bits UNION ALL SELECT id + 1000000000, bits, seen FROM bits WHERE id % 3 = 0 UNION ALL SELECT id + 2000000000, xor(bits, ((1::UBIGINT << (id % 60)::UBIGINT) | 4::UBIGINT)), seen FROM bits WHERE id % 3 = 0)"""
PAIRS = """pairs AS (SELECT p.id, q.id AS match_id, bit_count(xor(p.bits, q.bits))::INT AS distance, q.seen FROM pics p JOIN pics q ON p.id <> q.id AND bit_count(xor(p.bits, q.bits)) <= 10)"""
ORACLES["phash_bits"] = f"WITH {PICS} SELECT id, phash, bit_count(bits)::INT AS ones FROM bits"
ORACLES["hamming_pairs"] = f"""WITH {PICS}, {PAIRS} SELECT id, match_id, distance, floor((1 - distance::DOUBLE / 64) * 1000 + 0.5) / 10.0::DOUBLE AS similarity_pct, CASE WHEN distance = 0 THEN 'EXACT' ELSE 'NEAR_DUPLICATE' END AS match_type FROM pairs"""
ORACLES["phash_verdict"] = f"""WITH {PICS}, {PAIRS}, l AS (SELECT id, count(*) AS n, arg_min(seen, distance::BIGINT * 100000000000 + match_id) AS near, min(seen) AS early FROM pairs GROUP BY id)
SELECT pics.id, coalesce(n, 0) AS local_duplicate_count, 0::BIGINT AS web_sighting_count, coalesce(n, 0) AS prior_sightings_count, coalesce(near, -1)::BIGINT AS earliest_local_match, coalesce(early, -1)::BIGINT AS first_created_at,
  CASE WHEN coalesce(n, 0) = 0 THEN 'NO_MATCH_FOUND' WHEN n <= 2 THEN 'PREVIOUSLY_SEEN' ELSE 'VIRAL_RECIRCULATION' END AS match_verdict, coalesce(n, 0) > 0 AS risk_signal FROM pics LEFT JOIN l ON l.id = pics.id"""
ORACLES["reverse_queries"] = rf"""WITH {CLAIMS}, w AS (SELECT claim_id, array_to_string(list_filter({words('claim')}, lambda x_: regexp_matches(x_, '^[\p{{L}}\p{{N}}]+$'))[1:15], ' ') AS j FROM claims)
SELECT claim_id, '"' || j || '"|' || j || ' news report' AS queries FROM w"""
_ai = """CASE WHEN heavy THEN 'UNKNOWN' WHEN ai >= 0.75 THEN 'LIKELY_AI_GENERATED' WHEN ai >= 0.55 OR (ai >= 0.4 AND f > 0.6) THEN 'POSSIBLY_AI_GENERATED' WHEN e >= 0.75 OR c >= 0.6 THEN 'LIKELY_MANIPULATED'
  WHEN e >= 0.6 OR n >= 0.6 OR c >= 0.4 THEN 'POSSIBLY_MANIPULATED' WHEN ai < 0.2 AND e < 0.2 AND n < 0.2 AND c < 0.2 THEN 'LIKELY_AUTHENTIC' WHEN ai < 0.35 AND greatest(e, n, c) < 0.35 THEN 'POSSIBLY_AUTHENTIC' ELSE 'UNKNOWN' END"""
ORACLES["ai_likelihood"] = f"""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_discount * 10 AS e, l_tax * 12.5::DOUBLE AS n, l_quantity / 50 AS f, (l_linenumber % 8) / 8.0::DOUBLE AS c FROM lineitem),
a AS (SELECT *, least(f * 0.5::DOUBLE + n * 0.25::DOUBLE + e * 0.25::DOUBLE, 1.0::DOUBLE) AS ai, f > 0.8 AND e < 0.15 AND n < 0.15 AS heavy FROM s), l AS (SELECT *, {_ai} AS label FROM a)
SELECT seq, CASE WHEN label <> 'UNKNOWN' THEN {to('ai', 4)} END AS score, label, CASE WHEN heavy THEN 'rule_based_calibration' ELSE 'heuristic_ensemble_v1' END AS model FROM l"""
_map = "CASE lower(label) " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in K.LABEL_SCORES.items()) + " ELSE 0.5 END"
ORACLES["consistency_score"] = f"""WITH {CLAIMS}, i AS (SELECT claim_id, claim, {D.joined(D.pick('claim_id', D.VERBS), "' '", D.pick('submission_id', D.OBJECTS))} AS ocr, CASE WHEN claim_id % 4 = 0 THEN 'seen in 2020 again' ELSE '' END AS raw,
  {D.pick('claim_id', ['VIRAL_RECIRCULATION', 'NO_MATCH_FOUND', 'POSSIBLE_DUPLICATE'])} AS ph, CASE WHEN claim_id % 6 <> 0 THEN (2016 + submission_id % 10)::INT END AS exif, {D.pick('submission_id', list(K.LABEL_SCORES) + ['other', ''])} AS label FROM claims),
w AS (SELECT *, {overlap_words('ocr')} AS a, {overlap_words('claim')} AS b, list_min(list_transform(list_concat({_years.format('claim')}, {_years.format('raw')}), lambda y_: abs(y_::INT - exif))) AS diff FROM i),
p AS (SELECT *, {jaccard('a', 'b')} AS o, CASE WHEN diff IS NULL THEN 0.5 WHEN diff = 0 THEN 1.0 WHEN diff <= 1 THEN 0.7 WHEN diff <= 3 THEN 0.4 ELSE 0.0 END::DOUBLE AS d, CASE ph WHEN 'VIRAL_RECIRCULATION' THEN 0.1 WHEN 'POSSIBLE_DUPLICATE' THEN 0.4 ELSE 0.8 END::DOUBLE AS v,
  CASE WHEN label = '' THEN 0.5 ELSE {_map} END::DOUBLE AS m FROM w)
SELECT claim_id, {to('least(greatest((0.0::DOUBLE + o * 0.35::DOUBLE + d * 0.2::DOUBLE + v * 0.25::DOUBLE + m * 0.2::DOUBLE) / 1.0::DOUBLE, 0), 1)', 4)} AS score, {to('o', 4)} AS ocr_overlap, coalesce(diff::INT, -1) AS year_diff,
  ((CASE WHEN o < 0.05 OR o > 0.4 THEN 1 ELSE 0 END) + (CASE WHEN diff >= 2 THEN 1 ELSE 0 END) + (CASE WHEN ph <> 'NO_MATCH_FOUND' THEN 1 ELSE 0 END) + (CASE WHEN label <> '' AND m < 0.4 THEN 1 ELSE 0 END))::INT AS n_flags FROM p"""
ORACLES["noise_blocks"] = f"""WITH e AS (SELECT vec_id AS id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings), v AS (SELECT id, i // 32 * 2 + (i % 8) // 4 AS block, var_pop(x) AS var FROM e GROUP BY ALL)
SELECT id, {to('var_pop(var) * 1e6', 4)} AS var_of_var, count(*) AS blocks FROM v GROUP BY id"""
_text = D.pick("l_partkey", ["Heavy", "rain", "45%", "lashes", "5G", "11:42 am", "Mumbai", "x", "7", "  2024  "])
REGIONS = rf"""r0 AS (SELECT l_orderkey AS image_id, {D.pick('l_suppkey', ['PaddleOCR', 'Tesseract'])} AS engine, {D.pick('l_suppkey', ['original', 'clahe', 'deskew'])} AS variant, {collapse(_text)} AS text, l_quantity / 50 AS confidence, l_linenumber::DOUBLE AS x, l_quantity * 6 AS y FROM lineitem),
reg AS (SELECT *, CASE WHEN confidence > 0.8 THEN 'HIGH' ELSE 'LOW' END AS reliability FROM r0 WHERE (length(text) >= 2 OR regexp_matches(text, '[0-9]')) AND NOT (text = '' OR regexp_matches(lower(text), '^(?:[0-9]{{1,3}}\s*%|(?:4g|5g|lte|volte|wifi|3g|e|h\+)|[0-9]{{1,2}}:[0-9]{{2}}(?:\s*(?:am|pm))?)$')))"""
ORACLES["ocr_regions"] = f"WITH {REGIONS} SELECT image_id, engine, variant, text, reliability, count(*) AS n FROM reg GROUP BY ALL"
_order = "string_agg(text, ' ' ORDER BY round_even(y / 24, 0) * 24, x, text)"
ORACLES["ocr_lines"] = f"WITH {REGIONS} SELECT image_id, {_order} AS text FROM reg GROUP BY image_id"
ORACLES["ocr_consensus"] = rf"""WITH {REGIONS}, m AS (SELECT image_id, engine, variant, avg(confidence) AS mean, count(*) AS n, {_order} AS text FROM reg GROUP BY ALL),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY mean DESC, engine DESC, variant DESC) = 1)
SELECT image_id, 'SUCCESS' AS status, engine || '-' || variant AS engine_used, {to('mean', 3)} AS overall_confidence, n AS n_regions, text, regexp_matches(text, '[\x{{0900}}-\x{{097F}}]') AS has_devanagari FROM b"""

# --- lifecycle

LIFE = f"life AS ({D.LIFECYCLE})"
ORACLES["status_latest"] = f"WITH {LIFE} SELECT key, status, ts FROM life QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1"
ORACLES["status_stream"] = ORACLES["status_latest"]
ORACLES["status_moves"] = f"""WITH {LIFE}, p AS (SELECT key, event_id, status, lag(status) OVER (PARTITION BY key ORDER BY ts, event_id) AS previous FROM life)
SELECT * FROM p WHERE NOT ((status = 'queued' AND previous IS NULL) OR (status = 'processing' AND coalesce(previous IN ('queued', 'error'), false)) OR (status = 'complete' AND coalesce(previous = 'processing', false)) OR (status = 'error' AND coalesce(previous IN ('queued', 'processing'), false)))"""
ORACLES["events_tumbling"] = f"SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type AS kind, count(*) AS n, {to('sum(value)', 2)} AS total FROM events GROUP BY ALL"
ORACLES["events_stream"] = """WITH w AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
ORACLES["rate_limit"] = "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1"
ORACLES["ttl_cache"] = """WITH l AS (SELECT user_id AS key, event_id AS value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT * FROM l WHERE ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-10'"""
_mimes = ["image/jpeg", "image/png", "text/plain", "image/webp", "image/gif"]
_files = ["FFD8FFE000104A46", "89504E470D0A1A0A", "47494638396100", "524946460000000057454250", "7468697320697320", "000000000000000057454250"]
ORACLES["upload_checks"] = f"""WITH f AS (SELECT event_id, {D.pick('event_id', _files)} AS h, {D.pick('event_id', _mimes)} AS mime FROM events)
SELECT event_id, CASE WHEN mime NOT IN ({', '.join(map(lit, I.MAGIC))}) THEN '415:type' WHEN NOT (starts_with(h, 'FFD8FF') OR starts_with(h, '89504E47') OR starts_with(h, '52494646') OR starts_with(h, '47494638') OR substring(h, 17, 8) = '57454250') THEN '415:content' END AS reject FROM f"""
_ips = ["http://10.0.0.7/a", "https://172.20.1.1:8443/", "http://192.168.1.4", "ftp://example.org/f", "https://example.org/x", "http://user@127.0.0.1/", "http://8.8.8.8/", "http://localhost:80/", "javascript:alert(1)"]
ORACLES["url_safety"] = f"""WITH u AS (SELECT event_id, {D.pick('event_id', _ips)} AS url FROM events), s AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS scheme, regexp_replace(regexp_replace({netloc('url')}, '^.*@', ''), ':[0-9]*$', '') AS host FROM u),
a AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN list_transform(string_split(host, '.'), lambda x_: x_::INT) END AS ip FROM s)
SELECT event_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'host' WHEN host = 'localhost' OR ip[1] IN (0, 10, 127) OR (ip[1] = 172 AND ip[2] BETWEEN 16 AND 31) OR (ip[1] = 192 AND ip[2] = 168) OR (ip[1] = 169 AND ip[2] = 254) THEN 'private' END AS reason FROM a"""
ORACLES["filenames"] = rf"""WITH n AS (SELECT p_partkey, regexp_replace(p_name || ' / ' || p_type || ' * ' || p_brand || {D.pick('p_partkey', ['.PNG', '.exe', '', '.jpeg'])}, '[^\p{{L}}\p{{N}}_.\-]', '_', 'g') AS c FROM part),
x AS (SELECT *, regexp_extract(lower(c), '(\.(?:jpg|jpeg|png|webp|gif))$', 1) AS ext FROM n) SELECT p_partkey, substring(c, 1, least(length(c) - length(ext), 64 - length(ext))::INT) || ext AS name FROM x"""

def _bare(x: str) -> str:
    return rf"""regexp_replace({x}, '^[("''\[]+|[)"''\],;:]+$', '', 'g')"""


def _word_type(x: str) -> str:
    low = rf"lower(regexp_replace({x}, '\.$', ''))"
    return rf"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({low}, '^[0-9][0-9.,]*$') THEN '##' WHEN regexp_matches({low}, '[\p{{L}}\p{{N}}]') THEN {low} ELSE '' END"


def _ratio(a: str, b: str, both: str, n: str) -> str:
    def log(k: str, m: str, p: str) -> str:
        q = f"greatest(least({p}, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE)"
        return f"({k} * ln({q}) + ({m} - {k}) * ln(1 - {q}))"

    p, p1, p2 = f"({b}::DOUBLE / {n})", f"({both}::DOUBLE / {a})", f"(({b} - {both})::DOUBLE / greatest({n} - {a}, 1))"
    return f"CASE WHEN {p1} > {p} THEN 2 * ({log(both, a, p1)} + {log(f'({b} - {both})', f'({n} - {a})', p2)} - {log(both, a, p)} - {log(f'({b} - {both})', f'({n} - {a})', p)}) ELSE 0.0 END"


_TOKENS = rf"""w AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda w_: w_ <> '') AS w FROM documents),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), b AS (SELECT lang, {_bare('w[i]')} AS b, CASE WHEN i > 1 THEN {_bare('w[i - 1]')} END AS p FROM x),
tk AS (SELECT lang, {_word_type('b')} AS word, ends_with(b, '.') AND NOT ends_with(b, '..') AS dot, {_word_type('p')} AS before, ends_with(p, '.') AND NOT ends_with(p, '..') AS before_dot FROM b),
c AS (SELECT lang, word, count(*) AS n, count(CASE WHEN dot THEN 1 END) AS n_dot FROM tk WHERE word <> '' GROUP BY ALL), s AS (SELECT lang, sum(n)::BIGINT AS alln, sum(n_dot)::BIGINT AS dots FROM c GROUP BY ALL),
r AS (SELECT c.*, least(dots::DOUBLE / alln, 1 - 1e-9::DOUBLE) AS p, n - n_dot AS wo, length(replace(word, '.', '')) AS le FROM c JOIN s USING (lang) WHERE n_dot > 0 AND word <> '##'),
pw AS (SELECT lang, word, n, n_dot, {to('-2 * ((n_dot * ln(p) + wo * ln(1 - p)) - (n_dot * ln(0.99::DOUBLE) + wo * ln(1 - 0.99::DOUBLE))) * exp(-le) * (length(word) - le + 1) * pow(greatest(le, 1)::DOUBLE, -wo)', 4)} AS score FROM r)"""
ORACLES["period_words"] = f"WITH {_TOKENS} SELECT *, score >= 0.3 AS abbreviation FROM pw"
ORACLES["sentence_starters"] = rf"""WITH {_TOKENS}, q AS (SELECT lang, before, word, count(*) AS n FROM tk WHERE before_dot AND before <> '' AND word <> '' GROUP BY ALL),
e AS (SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM pw WHERE pw.lang = q.lang AND pw.word = q.before AND score >= 0.3) AND NOT regexp_matches(before, '^(?:\p{{L}}|##)$')),
f AS (SELECT lang, word, sum(n)::BIGINT AS n_after FROM e GROUP BY ALL), k AS (SELECT lang, sum(n)::BIGINT AS breaks FROM e GROUP BY ALL),
g AS (SELECT f.lang, f.word, c.n, n_after, {to(_ratio('breaks', 'c.n', 'n_after', 'alln'), 2)} AS ratio FROM f JOIN c USING (lang, word) JOIN k USING (lang) JOIN s USING (lang)) SELECT * FROM g WHERE ratio >= 30"""


def _ended(rows: str, event: str, seconds: int) -> str:
    gap = f"CASE WHEN nxt IS NOT NULL THEN nxt - ts > INTERVAL {seconds} SECOND ELSE ts + INTERVAL {seconds} SECOND < (SELECT max(ts) - INTERVAL 10 MINUTE FROM {rows}) END"
    return f"n AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, {event}) AS nxt FROM {rows} WHERE key IS NOT NULL), g AS (SELECT *, {gap} AS stuck FROM n)"


ORACLES["ended_runs"] = f"WITH {LIFE}, {_ended('life', 'event_id', 172_800)} SELECT key, CASE WHEN status IN ('complete', 'error') THEN status ELSE 'timeout' END AS status, ts, event_id FROM g WHERE status IN ('complete', 'error') OR stuck"
ORACLES["expired_entries"] = f"WITH wr AS (SELECT user_id AS key, event_id AS value, ts FROM events), {_ended('wr', 'value', 86_400)} SELECT key, value, ts FROM g WHERE stuck"

ORACLES["sessions_sql"] = """WITH a AS (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE ts IS NOT NULL), b AS (SELECT *, coalesce(t - lag(t) OVER w > 3600, false)::INT AS cut FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT user_id, t, sum(cut) OVER (PARTITION BY user_id ORDER BY t)::INT AS session_ix FROM b) SELECT user_id, session_ix, min(t) AS first, max(t) AS last, count(*) AS n FROM c GROUP BY ALL"""
ORACLES["sentences_sql"] = rf"""WITH r AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace({strip("coalesce(text, '')")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda s: s <> '') AS l FROM conversations)
SELECT conv_id, turn, unnest(range(len(l)))::INT AS sent_ix, unnest(l) AS sentence FROM r"""
