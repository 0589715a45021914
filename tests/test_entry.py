"""Each query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from datelode import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted(map(repr, pdf.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    found = {r.bucket: r.n for r in entry.entry(spark).collect()}
    assert sum(found.values()) == 1000 and set(found) <= {"confident", "review", "duplicate", "unsupported"}


def test_mined_patterns(spark):
    found = {r.name: r for r in catalog.queries()["mined_patterns"](spark, SF).collect()}
    assert found["MINED_4_4_6_second"].confidence == 0.89


def test_all_have_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"tagger_fitted"}  # a fitted network; tests/test_char_tagger.py
