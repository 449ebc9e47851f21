"""Every registered query against its SQL twin, and the shape of the driver contract."""

from __future__ import annotations

import re

import oracle
import pytest

import __spark_entry__ as entry_module
from twinproof.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(name, spark, data, con):
    assert oracle.compare(catalogue.QUERIES[name](spark, data), con, catalogue.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(name, spark, data):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry_is_the_flagship(spark):
    df = entry_module.entry(spark)
    assert {"table", "match", "all_match", "ledger_ok"} <= set(df.columns)
    assert {r["table"]: r["match"] for r in df.collect()} == {"orders": False, "lineitem": False, "customer": True}


def test_contract():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 100


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plan_has_no_product_and_no_python(name, spark, data):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert operator not in plan


def test_scan_reads_only_compared_columns(spark, data):
    plan = catalogue.QUERIES["cdc_new_table"](spark, data)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("props" not in s and "value" not in s for s in schemas)
