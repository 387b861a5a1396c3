"""Optional backends: language models, taggers, text recognition. All off by default.

A backend is a plain callable over pandas batches that runs in Python workers;
a backend that fails on a batch leaves the deterministic result in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame

Backend = Callable[[pd.Series], pd.Series]
_registered: dict[str, Callable[[], Backend]] = {}


def register(kind: str, factory: Callable[[], Backend]) -> None:
    """factory is called once per task, on the executor."""
    _registered[kind] = factory


def unregister(kind: str) -> None:
    _registered.pop(kind, None)


def available(kind: str) -> bool:
    return kind in _registered


def corrected(df: DataFrame, kind: str, column: str, failures: Accumulator[int] | None = None) -> DataFrame:
    """df with column passed through the backend of that kind; unchanged without one, or where it fails or returns null.

    failures counts the batches on which the backend failed.
    """
    if kind not in _registered:
        return df
    factory, schema = _registered[kind], df.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = factory()
        for b in batches:
            try:
                out = backend(b[column])
                b = b.assign(**{column: out.where(out.notna(), b[column])})
            except Exception:  # a backend's failure never fails the query
                if failures is not None:
                    failures.add(1)
            yield b

    return df.mapInPandas(run, schema)
