"""Secret scans over an incremental blob ledger.

Every historical version of a file is a blob, named by the SHA-256 of its
content. The ledger is an append-only table with one row per blob and rule
version that was scanned, findings included. A scan takes the pairs the
ledger lacks, scans one copy of each blob, appends, and joins the findings
back to every path that ever held the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import ship, small_batches, written

#: Kinds in the order that breaks ties of equal starts: name, pattern, group whose length counts, least length. Fixed values.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: What the scan finds beyond the base kinds.
ADDED = (
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"), 0, 1),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"), 0, 1),
    ("forge", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"), 0, 1),
    ("chat", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    ("url_login", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{3,80}@"), 0, 1),
    ("bearer", re.compile(r"\bBearer\x20+([A-Za-z0-9+/_.=-]{16,})"), 1, 16),
)
RULE_VERSION = "2"
_KINDS = {k: i for i, (k, *_) in enumerate(BASE + ADDED)}
#: A text without a kind's needle can't hold it; saves the pattern's run.
_NEEDLES = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "private_key": ("-----begin",), "jwt": ("eyj",), "forge": ("gh", "glpat-"), "chat": ("xox",), "url_login": ("://",), "bearer": ("bearer",)}
_HEX = re.compile(r"[0-9a-f]{24,}")


def scan_text(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings in code points, by start, then kind as listed."""
    if not text:
        return []
    low, out = text.lower(), []
    for kind, pattern, group, least in BASE + ADDED:
        if any(n in low for n in _NEEDLES.get(kind, ("",))):
            # a run of hex digits is either long enough as a whole or fails, so the length may stand in the pattern
            found = (_HEX if kind == "hex" else pattern).finditer(text)
            out += [(m.start(), m.end(), kind) for m in found if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda x: (x[0], _KINDS[x[2]], x[1]))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    base = {k for k, *_ in BASE}
    for b in batches:
        rows = []
        for sha, text in zip(b["blob"], b["text"]):
            found = scan_text(text)
            spans = [f"{k}:{s}:{e}" for s, e, k in found]
            count = {k: sum(1 for x in found if x[2] == k) for k in base}
            digest = hashlib.sha256(",".join(x for x, f in zip(spans, found) if f[2] in base).encode()).hexdigest()
            rows.append((sha, count["assign"], count["access"], count["hex"], digest, ",".join(spans)))
        yield pd.DataFrame(rows, columns=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], dtype=object)


LEDGER = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, one row per blob and rule version; a path that doesn't exist is an empty ledger.

    Scans that overlap may append a blob twice, with equal findings.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule_version"])


def scan_versions(versions: DataFrame, ledger: str, path_col: str = "doc_id", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at path ledger lacks, append it, and return a row per version.

    versions: a row per path and historical version, with its text; null texts
    are empty blobs. Result: path_col, blob, n_assign, n_access, n_hex,
    base_sha256, spans (lists are comma-joined kind:start:end, empty if there
    are none). Rows repeat as in versions, null paths included; other columns
    are ignored; an empty table gives an empty result and scans nothing.
    """
    spark = versions.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    blob = F.unhex(F.sha2(text.cast("binary"), 256))
    at = written(versions.select(F.col(path_col).alias("path"), blob.alias("blob")))
    # one copy of each unseen blob: its smallest path; the text stays where it lies until that is known
    unseen = at.groupBy("blob").agg(F.min("path").alias("path")).join(read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    keys = [F.col("t.path").eqNullSafe(F.col("u.path")), F.col("t.blob") == F.col("u.blob")]
    todo = versions.select(F.col(path_col).alias("path"), blob.alias("blob"), text.alias("text")).alias("t").join(unseen.alias("u"), keys, "left_semi").select("t.blob", "t.text")
    found = todo.mapInPandas(_scan, "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    # a version repeated under one path is scanned again; the ledger takes it once
    rows = found.dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    with small_batches(spark):
        rows.write.mode("append").parquet(ledger)
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).drop("rule_version")
    return at.join(known, "blob").select(F.col("path").alias(path_col), "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
