"""Table functions for queries that are written in SQL only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StructType

#: sentences_of(text): sentences as functions.text.sentences cuts them, by expressions alone.
SENTENCES = r"""CREATE OR REPLACE TEMPORARY FUNCTION sentences_of(body STRING) RETURNS TABLE(sent_ix INT, sentence STRING) RETURN
SELECT pos, col FROM (SELECT posexplode(filter(transform(
  split(regexp_replace(regexp_replace(coalesce(body, ''), r'^\s+|\s+$', ''), r'([.!?])\s+', concat('$1', chr(1))), chr(1)),
  s -> regexp_replace(s, r'^\s+|\s+$', '')), s -> s <> '')))"""


@udtf
class Sessions:
    """sessions_of(TABLE(...) PARTITION BY key ORDER BY (time), gap): a row for each run of rows whose neighbours
    are no more than gap apart: key, session_ix (from 0), first, last, n.

    The table's first column is the key and its second the time as a number;
    others are ignored. Rows without time are left out. Rows come ordered and
    one by one, so a partition of any size takes constant memory.
    """

    def __init__(self) -> None:
        self.open: list | None = None
        self.n = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("sessions_of takes a table of a key and a time")
        if gap.value is None or gap.value < 0:
            raise ValueError("the gap must be a constant of no less than 0")
        key = rows.dataType.fields[0].dataType
        return AnalyzeResult(StructType().add("key", key).add("session_ix", IntegerType()).add("first", LongType()).add("last", LongType()).add("n", LongType()))

    def eval(self, row, gap: int) -> Iterator[tuple]:
        key, time = row[0], row[1]
        if time is None:
            return
        if self.open and time - self.open[2] <= gap:
            self.open[2], self.open[3] = time, self.open[3] + 1
            return
        if self.open:
            yield self._closed()
        self.open = [key, time, time, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self._closed()

    def _closed(self) -> tuple:
        key, first, last, n = self.open
        self.n += 1
        return key, self.n - 1, first, last, n


def register(spark: SparkSession) -> None:
    """Make sentences_of and sessions_of known to the session's SQL."""
    spark.sql(SENTENCES)
    spark.udtf.register("sessions_of", Sessions)
