"""Every registered query against its SQL twin, on the smallest tables."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import SMALL, frame, views
from postscreen.bindings.oracle import ORACLE
from postscreen.bindings.queries import QUERIES

ITERATIVE = {"lr_predict", "meta_predict", "epoch_scores"}
# A vocabulary file that SQL can't read.
WITHOUT_SQL = ITERATIVE | {"metrics_by_epoch", "subword_vocab", "subword_encode", "padded_batches"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    views(connection, SMALL)
    return connection


def test_entry(spark):
    assert {r["depressive"]: r["count"] > 0 for r in entry(spark).collect()} == {0: True, 1: True}


def test_every_query_has_sql_unless_it_trains_iteratively():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join (Cross|Inner\s*$)", plan, re.M), "cross join"
    a, b = frame(df.toPandas()), frame(db.execute(oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(ITERATIVE))
def test_scores_of_iterative_models(spark, name):
    df = queries()[name](spark, SMALL)
    assert df.filter("p1 between 0 and 1 and pred in (0, 1)").count() == df.count() > 0


@pytest.mark.parametrize(
    "name,columns",
    [("split_bucket", "doc_id:bigint,text:string"), ("box_outliers", "lang:string"), ("head_rows", "doc_id:bigint,lang:string,source:string")],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{columns}>" in plan
