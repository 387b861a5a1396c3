"""The engine's tables as DDL, and the values that columns of fixed choice may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ENTITIES = "struct<persons:array<string>,orgs:array<string>,locations:array<string>,dates:array<string>,numbers:array<string>,concepts:array<string>>"

TABLES = {
    "users": "id string, created_at timestamp, ip_hash string",
    "submissions": "id string, user_id string, input_type string, raw_text string, image_path string, status string, error_message string, created_at timestamp, completed_at timestamp",
    "claims": f"id string, submission_id string, claim_text string, subject string, predicate string, object string, entities {_ENTITIES}, keywords array<string>, search_queries array<string>, created_at timestamp",
    "entities": "id string, name string, entity_type string, normalized_name string",
    "claim_entities": "id string, claim_id string, entity_id string, start_char int, end_char int",
    "sources": "id string, url string, domain string, source_type string, authority_score double, quality_score double, quality_components map<string,double>, first_seen timestamp",
    "documents": "id string, source_id string, title string, content string, content_hash string, publication_date date, author string, language string, chunks array<string>, retrieved_at timestamp",
    "search_results": "id string, claim_id string, query string, provider string, result_url string, title string, snippet string, domain string, rank int, retrieved_at timestamp",
    "evidence": "id string, claim_id string, document_id string, evidence_text string, support_score double, contradiction_score double, relevance_score double, retrieval_method string, indicators struct<relationship:string,is_allegation:boolean,platform:string,author:string,reason:string>, created_at timestamp",
    "images": "id string, submission_id string, original_filename string, stored_path string, mime_type string, file_size_bytes int, width int, height int, sha256_hash string, phash string, dhash string, ahash string, ocr_text string, ocr_confidence double, created_at timestamp",
    "image_forensics": "id string, image_id string, ela_score double, noise_anomaly double, edge_anomaly double, frequency_anomaly double, compression_anomaly double, metadata_anomaly double, copy_move_score double, ai_likelihood_score double, ai_likelihood_label string, exif map<string,string>, forensic_features map<string,string>, stats map<string,string>, phash_match struct<local_duplicate_count:bigint,web_sighting_count:bigint,prior_sightings_count:bigint,earliest_local_match:timestamp,match_verdict:string,risk_signal:boolean>, analyzed_at timestamp",
    "verdicts": "id string, submission_id string, claim_verdict string, claim_confidence double, image_verdict string, image_confidence double, overall_status string, support_score double, contradiction_score double, source_quality_score double, independent_source_count int, duplicate_source_group_count int, multimodal_consistency_score double, explanation string, score_components map<string,double>, limitations array<string>, created_at timestamp",
    "timelines": "id string, submission_id string, source_id string, document_id string, event_date date, event_description string, created_at timestamp",
    "evidence_graph_edges": "id string, submission_id string, from_node_type string, from_node_id string, to_node_type string, to_node_id string, relationship_type string, weight double, created_at timestamp",
}

# Choices.
CHOICES = {
    ("submissions", "status"): ["queued", "processing", "complete", "error"],
    ("submissions", "input_type"): ["text", "image", "multimodal"],
    ("evidence_graph_edges", "relationship_type"): ["SUPPORTS", "CONTRADICTS", "CONTEXT", "RELATED_IMAGE", "MENTIONS", "DERIVED_FROM"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def stable_id(*parts: Column) -> Column:
    """An id derived from a row's natural key, so that a retry writes the same row."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 36)


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows whose column of fixed choice holds another value, with the column's name."""
    out = None
    for (t, c), allowed in CHOICES.items():
        if t == name:
            bad = df.where(F.col(c).isNotNull() & ~F.col(c).isin(allowed)).withColumn("violation", F.lit(c))
            out = bad if out is None else out.unionByName(bad)
    return df.limit(0).withColumn("violation", F.lit("")) if out is None else out


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose non-null key has no parent, in place of a foreign key."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("parent__")), F.col(key) == F.col("parent__"), "left_anti")
