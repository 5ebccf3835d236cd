"""Queries against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in sorted(Path(SF).glob("*.parquet"))]
ORACLES = {n: q for n, q in entry.oracle_sql().items() if not n.startswith("op")}


def plain(rows):
    value = lambda v: v.tolist() if hasattr(v, "tolist") else v
    return sorted(repr(tuple(map(value, r))) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["put_get_roundtrip", "xor_roundtrip"])
def test_odd_documents(spark, tmp_path, name):
    """Null and empty texts, null ids, ids that rows share, with equal and with other texts."""
    rows = [(1, "a"), (2, ""), (3, None), (7, "same"), (7, "same"), (8, "one"), (8, "other" * 2000), (8, None), (None, "no id"), (None, ""), (9, "z" * 40_000), (10, "z" * 40_001), (14, ""), (14, ""), (-5, "ä\0𝄞" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    odd = duckdb.connect()
    odd.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = odd.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(want)
