"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns[:2] == ["session_id", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    mine, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cursor = db.execute(SQL[name])
        theirs, their_columns = rows_of([c[0] for c in cursor.description], cursor.fetchall())
        assert columns == their_columns
        assert mine == theirs


def test_rerank_of_a_memory_without_fingerprint(spark, tmp_path):
    """A text of stop words alone has no fingerprint; its copy must not be ranked beside it."""
    rows = [(5113, turn, "user", "The this the an, by, an are.") for turn in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{SF_DIR}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = QUERIES["r11_rerank"](spark, str(tmp_path))
    mine, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(SQL["r11_rerank"])
    theirs, their_columns = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert mine and columns == their_columns and mine == theirs
