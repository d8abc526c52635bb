"""The registry as the driver sees it, and a cross-section of queries against their SQL.

`python tests/oracle_check.py sf0.01` compares every query; this keeps the suite short.
"""

import json
import os

import pytest

from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
SAMPLE = (
    "norm_09_mw_digiacomo", "flt_09_remote_events", "join_01_close_pairs", "agg_01_canonical_events", "agg_06_completeness_fit", "agg_15_periodicity",
    "mod_16_feature_table", "agg_21_roc_auc", "agg_24_reliability", "mod_05_isotonic", "join_08_followers", "agg_31_log_likelihood", "agg_27_superposed_rates",
    "src_04_split_files", "src_10_balanced_windows", "src_12_last_per_id", "join_10_point_in_polygon", "join_13_hierarchy", "agg_27_hierarchy_rates",
    "mod_15_calibrated_m6", "plan_catalog_build",
)


def test_names_are_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(oracles) <= set(queries)
    own = [name for name in queries if name != "pipeline" and not name.startswith("op")]  # those come and go with their subpackage
    families = {name.rsplit("_", 1)[0].split("_")[0] for name in own}
    assert families == {"src", "snk", "norm", "flt", "join", "agg", "win", "top", "set", "math", "str", "date", "arr", "json", "cond", "mod", "plan"}


@needs_tables
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "region" and df.count() > 0


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    status, n, _, _, note = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok" or (status == "EMPTY" and n == 0), note


@needs_tables
def test_documents_parse(spark):
    for name in ("mod_18_dashboard", "snk_07_context_document", "snk_07_forecast_document"):
        rows = entry.queries()[name](spark, SF).collect()
        assert len(rows) == 1 and json.loads(rows[0]["value"])


@needs_tables
def test_no_nested_loop_in_large_joins(spark):
    """Band join, features and point-in-polygon stay equi-joins."""
    for name in ("join_01_close_pairs", "mod_16_feature_table", "join_10_point_in_polygon"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
