"""Every registered query on the smallest tables, against its SQL statement where it has one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect
from trialkit.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
# resamples of 30 patients may leave the outcome model without a unique solution
LARGER = {"ate_bootstrap_ci": "/root/testdata/sf0.01"}
STUDY = {"drug_effect_summary", "sae_effect_matrix", "stratified_effect_matrix"}  # long; run by tools/check.py


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STUDY])
def test_query(spark, con, name):
    folder = LARGER.get(name, FOLDER)
    source = con if folder == FOLDER else connect(folder)
    verdict, _, _, detail = compare(spark, source, folder, name, QUERIES[name], SQL.get(name))
    assert verdict in ("ok", "rows"), detail


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


def test_entry_has_a_stable_schema(spark):
    found = entry(spark)
    assert {"drug", "hr", "pooled_hr", "p_bh"} <= set(found.columns) and found.count() > 0
