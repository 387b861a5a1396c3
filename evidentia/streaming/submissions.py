"""Submissions as a stream: each batch runs through the pipeline, and a bad submission ends as an error of its own.

Everything a batch writes lies in a folder of its number and replaces what an
earlier attempt left there, so a restart after a failure doubles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.plans.pipeline import Run, run_pipeline
from evidentia.plans.storage import kept
from evidentia.sources.search import SearchProvider, request_reject

STATUS = "submission_id string, status string, error_message string"
NO_ID, REPEATED = "422:no submission_id", "409:submission_id repeated"
TABLES = ("reports", "evidence", "rejected")


def checked(batch: DataFrame) -> DataFrame:
    """batch (submission_id, text) with error: why a row can't be run, null for the others. Of rows with one id, the smallest text is run."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("submission_id").orderBy("text"))
    rows = batch.withColumn("nth", order)
    error = F.when(F.col("submission_id").isNull(), NO_ID).when(F.col("nth") > 1, REPEATED).otherwise(request_reject(F.col("text")))
    return rows.withColumn("error", error).drop("nth")


def isolated(rows: DataFrame, run: Callable[[DataFrame], list[DataFrame]]) -> tuple[list[list[DataFrame]], DataFrame | None]:
    """What run returns for all rows, and the rows (submission_id, error_message) it fails for.

    Where a run fails its rows are halved by a hash of their ids, down to the
    ones that fail alone: n rows of which one is bad take about 2 log2(n) runs.
    Failures other than Spark's and Python's own errors in a run (a lost
    cluster, an interrupt) go on to the caller.
    """
    done: list[list[DataFrame]] = []
    failed: list[tuple[str, str]] = []
    ids = rows.select(F.col("submission_id").cast("string").alias("id"), F.xxhash64("submission_id").alias("h"))
    work = [(0, 1)]
    while work:
        part, parts = work.pop()
        mine = F.pmod(F.xxhash64("submission_id"), F.lit(parts)) == part
        some = rows if parts == 1 else kept(rows.where(mine))
        try:
            done.append(run(some))
        except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError, RuntimeError) as e:
            few = ids.where(F.pmod("h", F.lit(parts)) == part).limit(2).collect()
            if len(few) < 2 or parts >= 1 << 40:
                failed += [(r["id"], f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]) for r in few]
            else:
                work += [(part, 2 * parts), (part + parts, 2 * parts)]
    bad = rows.sparkSession.createDataFrame(failed, "submission_id string, error_message string") if failed else None
    return done, bad


def process_batch(batch: DataFrame, number: int, path: str, documents: DataFrame, provider: SearchProvider | None = None, run: Callable[..., Run] = run_pipeline) -> None:
    """Run the rows of a batch that may start and write reports, evidence, rejected, status and dead below path.

    A submission that an earlier batch has completed is not run again. Status:
    complete, or error with its message; dead holds the rows that were errors.
    """
    spark = batch.sparkSession
    rows = kept(checked(batch.select(F.col("submission_id").cast("string").alias("submission_id"), F.col("text").cast("string").alias("text"))))
    before = read_status(spark, path, number).where("status = 'complete'").select("submission_id")
    fine = kept(rows.where("error is null").join(before, "submission_id", "left_anti").select("submission_id", "text"))

    def attempt(some: DataFrame) -> list[DataFrame]:
        out = run(some, documents, provider)
        return [kept(t) for t in (out.full_reports, out.evidence, out.rejected)]

    done, failed = isolated(fine, attempt) if fine.limit(1).count() else ([], None)
    for i, name in enumerate(TABLES):
        parts = [tables[i] for tables in done]
        if parts:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            whole.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    errors = rows.where("error is not null").select("submission_id", "text", F.col("error").alias("error_message"))
    if failed is not None:
        errors = errors.unionByName(failed.join(fine, "submission_id").select("submission_id", "text", "error_message"))
    errors = kept(errors)
    errors.write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
    own = errors.where("error_message != '%s'" % REPEATED).select("submission_id", "error_message")
    good = fine.join(own, "submission_id", "left_anti").select("submission_id", F.lit("complete").alias("status"), F.lit(None).cast("string").alias("error_message"))
    status = good.unionByName(own.select("submission_id", F.lit("error").alias("status"), "error_message"))
    status.write.mode("overwrite").parquet(f"{path}/status/batch={number}")  # last: a batch with a status is whole


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of all batches; empty before the first."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}")


def read_status(spark: SparkSession, path: str, but: int | None = None) -> DataFrame:
    """Status rows of all batches (but one) with their batch."""
    rows = _read(spark, path, "status", STATUS)
    return rows if but is None else rows.where(F.col("batch") != but)


def poll(spark: SparkSession, path: str) -> DataFrame:
    """(submission_id, status, error_message) of the last batch that has the submission; rows without id are left to dead."""
    last = read_status(spark, path).where("submission_id is not null").groupBy("submission_id").agg(F.max_by(F.struct("status", "error_message"), "batch").alias("s"))
    return last.select("submission_id", "s.*")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "dead", "submission_id string, text string, error_message string")


def reports(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "reports", "submission_id string, report string")


def start(stream: DataFrame, path: str, documents: DataFrame, provider: SearchProvider | None = None, run: Callable[..., Run] = run_pipeline, **trigger) -> StreamingQuery:
    """Run stream (submission_id, text) in the background; poll() tells how far it is. trigger: as DataStreamWriter.trigger takes it, what there is by default."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: process_batch(batch, number, path, documents, provider, run)).start()
