"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]
_libc = ctypes.CDLL(None)
T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the place all executors see.

    The setting is the cluster's; only where it is unset in local mode (tests) a
    folder of this machine is chosen and set.
    """
    return f"{_checkpoint_dir(spark).rstrip('/')}/evidentia-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "evidentia-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 4 << 20) -> Iterator[None]:
    """Actions inside hand Python at most rows rows and about size bytes at a time: for texts, whose size has no bound by number."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        old = int(before[k]) if before[k] and before[k].isdigit() else 0
        spark.conf.set(k, str(min(old, v) if old > 0 else v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_caches: dict[object, object] = {}


def cached(owner: object, make: Callable[[], T]) -> T:
    """What an operator's tasks keep in their Python worker, one operator at a time: workers live on from stage to stage."""
    if owner not in _caches:
        if _caches:
            _caches.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(_libc, "malloc_trim"):
                _libc.malloc_trim(0)
        _caches[owner] = make()
    return _caches[owner]  # type: ignore[return-value]


def written(df: DataFrame, texts: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    texts: Python reads texts on the way, so in small batches.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    with small_batches(spark) if texts else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, *found: DataFrame) -> DataFrame:
    """docs without the rows whose row_key() some table of found (row__) has; all columns stay."""
    for rows in found:
        docs = docs.withColumn("row__", row_key()).join(rows.hint("shuffle_hash"), "row__", "left_anti").drop("row__")
    return docs


def row_key() -> Column:
    """A 64-bit hash of a row's id and text; xxhash64 skips nulls, so these are told apart by flags."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text"))


def rows_with(docs: DataFrame, bad: Callable[[str | None], bool]) -> DataFrame:
    """(row__): the row_key() of every row whose text is bad, a written table.

    Texts go to Python in small batches and none come back: the batches of an
    action of the caller may be as large as a partition, on either side.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row__").filter(pa.array([bad(t.as_py()) for t in b.column("text")], pa.bool_()))], ["row__"])

    return written(docs.select(row_key().alias("row__"), "text").mapInArrow(judge, "row__ long"), texts=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't inherit its path."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(_ROOT) in paths or Path.cwd() == _ROOT or getattr(spark.sparkContext, "_evidentia_sent", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "evidentia.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (_ROOT / "evidentia").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._evidentia_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo mod (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def fold_py(doc_id: int | None, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lowered, as UTF-8 (bytes.split cuts at exactly these six)."""
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows of df, or all if it has fewer: those whose key hashes lowest, ties by key.

    Rows far above the n-th hash are filtered out first, so that about n rows
    in total, not n of every partition, are ordered.
    """
    total = df.count()
    share = min(1.0, (1.5 * n + 100) / max(1, total))
    order = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    return df.where(order < int(share * (1 << 31)) + 1).orderBy(order, key).limit(n)
