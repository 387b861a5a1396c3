import re
import sys
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from evidentia.llm import decontam
from evidentia.llm.common import tokenizer_path

sys.path.insert(0, str(Path(__file__).parent))
from test_near_copies import brute_kept  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_ids":
            assert out.columns == columns
        tables.append([tuple(r) for r in out.collect()])
        docs = spark.createDataFrame(tables[-1], out.schema)
    start = duckdb.sql(f"select * from '{SF}/documents.parquet'").fetchall()
    toxic, dedup, clean, mixed, ids = tables
    assert set(toxic) <= set(start) and len(toxic) < len(start)

    kept = {r[0] for r in dedup}
    assert set(dedup) <= set(toxic) and len(kept) == len(dedup)
    assert sorted(kept) == brute_kept([r[:2] for r in toxic])  # 5-word shingles, similarity 0.8

    items = [" ".join(decontam.words(t)) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    leaks = {r[0] for r in dedup if any(x in " ".join(decontam.words(r[1])) for x in items)}
    assert leaks and kept - {r[0] for r in clean} == leaks

    assert {r[0] for r in mixed} <= {r[0] for r in clean} and max(mixed.count(r) for r in mixed) <= 2
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    by = {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in mixed}
    assert sorted((r[0], r[2]) for r in ids) == sorted((r[0], by[r[0]]) for r in mixed)
    assert sum(r[2] for r in ids) == max(r[1] + r[2] for r in ids)


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_that_drop_rows_hand_no_texts_to_the_callers_action(spark):
    """Its batches may hold a whole partition; the stages judge texts in small ones of their own and keep only what names a row."""
    docs = spark.createDataFrame([(1, "a clean text"), (None, None), (1, "a clean text"), (None, "")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("x"), "n_chars": F.length("text")})
    for stage in (P.drop_toxic, P.drop_benchmark):
        out = stage(spark, docs, SF)
        assert not re.search("MapIn(Arrow|Pandas)", out._jdf.queryExecution().toString())
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
