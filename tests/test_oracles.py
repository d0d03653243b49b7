"""Every catalogue query against its SQL, and plan rules that hold for all of them."""

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from barwright.plans.catalogue import CATALOGUE
from barwright.plans.oracles import ORACLES
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert CATALOGUE.keys() == ORACLES.keys()
    assert CATALOGUE.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()


def no_cross_or_nested_loop_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def checked_writes(monkeypatch):
    """Scratch tables cut a plan; what is written to them is checked too."""
    write = DataFrameWriter.parquet

    def checked(self, *args, **kwargs):
        no_cross_or_nested_loop_join(self._df)
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", checked)


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_equals_sql(spark, con, sf_dir, name, checked_writes):
    query, sql = CATALOGUE[name], ORACLES[name]
    verdict, rows, _, _ = compare(spark, con, sf_dir, query, sql, no_cross_or_nested_loop_join)
    assert verdict == "equal"
    assert rows or name.startswith("top_")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 150 and df.columns[0] == "symbol"
