import pytest

from evidentia.functions import text as T
from evidentia.sources import table_functions


def test_sentences_as_the_column_function(spark):
    table_functions.register(spark)
    rows = [(1, "One. Two!  Three?\n\nFour"), (2, None), (3, ""), (4, " \n "), (5, "No end"), (6, "a" * 300_000 + ". b"), (1, "Again. Again.")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(map(tuple, spark.sql("SELECT id, s.* FROM {df} AS t, LATERAL sentences_of(t.text) AS s", df=df).collect()))
    want = sorted(map(tuple, df.selectExpr("id", "text").select("id", T.F.posexplode(T.sentences(T.text("text")))).collect()))
    assert got == want and len(got) == 9


def test_sessions(spark):
    table_functions.register(spark)
    rows = [("a", 10, "x"), ("a", 0, "x"), ("a", 16, "x"), ("a", 100, "x"), ("b", None, "x"), (None, 5, "x"), (None, 7, "x"), ("a", 100, "x")]
    df = spark.createDataFrame(rows, "k string, at long, key string")
    got = spark.sql("SELECT * FROM sessions_of(TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY (at), 10)", df=df).collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 0, 0, 16, 3), ("a", 1, 100, 100, 2), (None, 0, 5, 7, 2)]
    assert spark.sql("SELECT * FROM sessions_of(TABLE(SELECT * FROM {df} WHERE false) PARTITION BY k ORDER BY (at), 10)", df=df).count() == 0
    with pytest.raises(Exception, match="gap"):
        spark.sql("SELECT * FROM sessions_of(TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY (at), -1)", df=df).collect()
