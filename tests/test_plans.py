"""Plan-shape guards for the scale design (checked on the smallest data)."""

import re

import pytest

from strata.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = REGISTRY[name](spark, SF)
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def shuffles(p):
    tree = p.split("\n\n")[0]
    return sum(1 for line in tree.splitlines() if re.search(r"\bExchange\b", line) and "Broadcast" not in line)


@pytest.mark.parametrize("name", ["layered_overlay", "overlay_newer", "incremental_sync", "sync_plan",
                                  "version_reconcile", "package_membership", "assemble"])
def test_merges_are_one_shuffle(spark, name):
    assert shuffles(plan(spark, name)) == 1


@pytest.mark.parametrize("name", ["process_scripts", "script_functions", "glob_filter", "pattern_profile",
                                  "path_exclude", "naming", "map_lines", "rewrite_lines", "scan_descriptors"])
def test_row_operators_are_narrow(spark, name):
    assert shuffles(plan(spark, name)) == 0


def test_scans_are_pruned_and_filters_pushed(spark):
    pm = plan(spark, "package_membership")
    assert "text:" not in re.findall(r"ReadSchema: (struct<.*?>)", pm)[0]      # the big text column is never read
    sy = plan(spark, "incremental_sync")
    assert "GreaterThanOrEqual(ts," in sy




def test_late_contents_are_neither_aggregated_nor_sorted(spark):
    p = plan(spark, "assemble_late")
    nodes = [n for n in p.split("\n\n") if re.match(r"\(\d+\) (Hash|Sort|ObjectHash)Aggregate|\(\d+\) (Sort|Exchange)\b", n.strip())]
    assert any("Aggregate" in n for n in nodes)
    for n in nodes:
        if "content#" in n:  # the fetch of contents by position, after the winners are known
            assert re.match(r"\(\d+\) Exchange", n.strip()) and re.search(r"hashpartitioning\(_file#\d+, _row#\d+", n)
