"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from reverie.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    if name in SQL:
        rel = db.sql(SQL[name])
        assert sorted(rel.columns) == cols
        assert got == plain(rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry_imports_without_the_optional_operators(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m == "reverie.llm" or m.startswith("reverie.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("reverie.llm", "corpus_pipeline"):  # as if they could not be imported
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.delattr(sys.modules["reverie"], "llm", raising=False)
    import __spark_entry__ as e

    assert set(e.queries()) == set(QUERIES) and e.oracle_sql() == SQL
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_natural_order_ranks_all_rows(spark, db, tmp_path):
    names = {7: "C#9", 8: "C#10", 10: "C#11", 11: None, 12: "C#8", 13: "B#99"}
    spark.createDataFrame(list(names.items()), "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["place"] for r in QUERIES["natural_order"](spark, str(tmp_path)).collect()}
    sql = SQL["natural_order"].replace("FROM customer", f"FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert got == dict(db.sql(sql).fetchall()) and got[10] > got[8]


def test_natural_key_of_long_numbers(spark):
    from pyspark.sql import functions as F

    from reverie.functions import text as T

    names = ["A1", "A#1", "a" + "9" * 21 + "7", "a" + "9" * 21 + "8", "a1" + "0" * 22, "a007b", "a8b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in rows] == ["A1", "A#1", "a007b", "a8b", "a" + "9" * 21 + "7", "a" + "9" * 21 + "8", "a1" + "0" * 22]
