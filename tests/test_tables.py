"""Rules as tables, long files and counters of a write."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strata.functions import globs
from strata.operators import patterns, quality, scripts
from strata.sources import files

GLOBS = ["**", "**/**", "a/**", "*.sql", "**/*.sql", "a/b/", "**/x.sql", "a/*/c.txt", "a/*.t?t", "**/a*b/**", "?", "*", "**/*", "x+(y)/[z].{q}", "a/**/*.tar.gz",
         "**/*.", "a**b/c", "**/fr/**/web/**", ".svn/**", "$^|/\\x"]


def test_glob_columns_give_the_same_regex(spark):
    got = spark.createDataFrame([(g,) for g in GLOBS], "g string").select("g", globs.globs_column_regex("g").alias("rx")).collect()
    assert {r.g: r.rx for r in got} == {g: globs.glob_to_regex(g) for g in GLOBS}


def rule_table(spark, rules):
    return spark.createDataFrame([tuple(r.get(f) for f in patterns.RULE_FIELDS) for r in rules],
                                 "package string, layer string, include array<string>, exclude array<string>, entry_prefix string, rule_order int")


def test_rule_table_equals_literal_rules(spark):
    rng = random.Random(7)
    seg = ["a", "b", "x.sql", "c.txt", "y.tar.gz", "aXb", "fr", "web", ".svn", "[z].{q}", "noext", ""]
    paths = {"/".join(rng.choice(seg) for _ in range(rng.randrange(1, 5))) for _ in range(300)}
    df = spark.createDataFrame([(p, f"l{i % 3}", i) for i, p in enumerate(sorted(paths))] + [(None, "l0", 9), ("a/x.sql", "l1", 1000)], "path string, layer string, id int")
    rules = [dict(package=f"p{i % 6}", layer=rng.choice([None, "l0", "l1"]), include=rng.sample(GLOBS, rng.randrange(0, 4)) or None,
                  exclude=rng.choice([None, [], rng.sample(GLOBS[2:], 2)]), entry_prefix=rng.choice([None, "in/"]), rule_order=i) for i in range(25)]
    for resolve in (True, False):
        want = patterns.package_membership(df, rules, resolve=resolve, tiebreak=["id"])
        got = patterns.package_membership_by_table(df, rule_table(spark, rules), resolve=resolve, tiebreak=["id"])
        assert got.columns == want.columns and rows(got) == rows(want)


def test_ten_thousand_rules_without_a_nested_loop(spark):
    rules = [dict(package=f"p{i}", include=[f"src/dir{i}/**", f"**/name{i}.sql"], exclude=[f"**/skip{i}/**"], rule_order=i) for i in range(10_000)]
    df = spark.range(2000).select(F.concat(F.lit("src/dir"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "/skip").otherwise("/keep"),
                                           (F.col("id")).cast("string"), F.lit("/name"), (F.col("id") + 5000).cast("string"), F.lit(".sql")).alias("path"))
    got = patterns.package_membership_by_table(df, rule_table(spark, rules))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(f"p{i + 5000}", i) for i in range(2000)} | {(f"p{i}", i) for i in range(2000) if i % 2}
    assert {(r.package, int(re.search("dir([0-9]+)/", r.source_path)[1])) for r in got.collect()} == want


@pytest.mark.parametrize("limit", [scripts.RULE_BYTES, 0])
def test_line_rules_as_a_table_equal_literal_ones(spark, limit):
    rules = [dict(vendor="v1", rule_order=2, pattern="b+", replacement="<$0>"), dict(vendor="v1", rule_order=1, pattern="a", replacement="bb"),
             dict(vendor="v2", rule_order=1, pattern="^x", replacement=""), dict(vendor="v3", rule_order=1, pattern="\\\\", replacement="/")]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate((v, c) for v in ("v1", "v2", "v3", "none", None) for c in ("aab\r\nxa", "", None, "x\\y\n\nx"))],
                               "id int, vendor string, content string")
    table = spark.createDataFrame([tuple(r.values()) for r in rules] + [(None, 1, "x", "y"), ("v1", 3, None, "y")], "vendor string, rule_order int, pattern string, replacement string")
    got = scripts.rewrite_lines_by_table(df, table, "vendor", broadcast_bytes=limit)
    assert rows(got) == rows(scripts.rewrite_lines(df, rules, vendor="vendor"))
    assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (limit > 0)


def test_lines_of_a_file_cut_over_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(20_000)]
    os.makedirs(tmp_path / "d")
    (tmp_path / "d" / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.txt").write_text("one\r\ntwo")
    (tmp_path / "empty.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = files.scan_lines(spark, str(tmp_path))
        assert found.where("path = 'd/big.txt'").select("block").distinct().count() > 20
        assert [r.line for r in found.where("path = 'd/big.txt'").orderBy("block", "at").collect()] == lines
        assert rows(files.last_lines(found)) == [("d/big.txt", lines[-1], 20_000), ("small.txt", "two", 2)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_unreadable_file_is_reported(spark, tmp_path):
    for name in ("a.sql", "b.sql", "gone.sql", "odd.sql"):
        (tmp_path / name).write_text(name)
    found = files.scan_files_reported(spark, str(tmp_path), ext=".sql")
    os.remove(tmp_path / "gone.sql")  # between the listing and the read
    os.remove(tmp_path / "odd.sql")
    os.makedirs(tmp_path / "odd.sql" / "x")
    got = {r.path: (r.status, r.content, (r.reason or "").split(":")[0]) for r in found.collect()}
    assert got == {"a.sql": ("OK", b"a.sql", ""), "b.sql": ("OK", b"b.sql", ""), "odd.sql": ("FAILED", None, got["odd.sql"][2])} and "Error" in got["odd.sql"][2]


def test_counters_of_a_write(spark, tmp_path):
    df = spark.createDataFrame([("NEW", 1), ("NEW", 2), ("UPDATED", 3), (None, 4)], "action string, x int")
    got = quality.written_counters(df, str(tmp_path / "out"))
    assert rows(got) == [("NEW", 2), ("TARGET_ONLY", 0), ("UNCHANGED", 0), ("UPDATED", 1)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
