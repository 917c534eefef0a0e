"""Edge cases the generated tables cannot reach (tiny hand-made inputs)."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strata.functions import globs, text
from strata.functions import versions as vfn
from strata.operators import (artifacts, descriptors, overlay, packages, patterns, quality, scripts,
                              sync, versions)

EV = "k string, ts long, v string"


# -------------------------------------------------------------------- sync
def test_sync_equal_time_is_noop_and_target_only_kept(spark):
    tgt = spark.createDataFrame([("a", 5, "t"), ("b", 5, "t"), ("c", 1, "t")], EV)
    src = spark.createDataFrame([("a", 5, "s"), ("b", 6, "s"), ("d", 1, "s")], EV)
    out = sync.incremental_sync(src, tgt, ["k"], "ts", with_action=True)
    assert rows(out, "k", "v", "action") == [("a", "t", "UNCHANGED"), ("b", "s", "UPDATED"),
                                             ("c", "t", "TARGET_ONLY"), ("d", "s", "NEW")]


def test_sync_null_source_time_never_updates_existing(spark):
    tgt = spark.createDataFrame([("a", 5, "t")], EV)
    src = spark.createDataFrame([("a", None, "s"), ("b", None, "s")], EV)
    out = sync.incremental_sync(src, tgt, ["k"], "ts")
    assert rows(out, "k", "v") == [("a", "t"), ("b", "s")]


def test_sync_empty_sides(spark):
    empty = spark.createDataFrame([], EV)
    one = spark.createDataFrame([("a", 1, "x")], EV)
    assert rows(sync.incremental_sync(empty, one, ["k"], "ts"), "k", "v") == [("a", "x")]
    assert rows(sync.incremental_sync(one, empty, ["k"], "ts"), "k", "v") == [("a", "x")]
    assert rows(sync.sync_plan(one, empty, ["k"], "ts"), "k", "action") == [("a", "NEW")]


def test_sync_is_idempotent(spark):
    tgt = spark.createDataFrame([("a", 5, "t"), ("b", 5, "t")], EV)
    src = spark.createDataFrame([("a", 7, "s"), ("c", 1, "s")], EV)
    once = sync.incremental_sync(src, tgt, ["k"], "ts")
    twice = sync.incremental_sync(src, once, ["k"], "ts")
    assert rows(once) == rows(twice)


def test_verify_copy_null_safe_lengths(spark):
    s = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, length long")
    t = spark.createDataFrame([("a", 1), ("b", None), ("c", 4), ("d", 1)], "k string, length long")
    assert rows(sync.verify_copy(s, t, ["k"]), "k", "status") == [("c", "LENGTH_DIFFERS"),
                                                                  ("d", "MISSING_IN_SOURCE")]


# ----------------------------------------------------------------- overlay
def test_overlay_newer_layer_needs_strictly_newer(spark):
    df = spark.createDataFrame([
        ("p", 1, 10, "base"), ("p", 2, 10, "same-time"),          # equal time: base stays
        ("q", 1, 10, "base"), ("q", 2, 11, "newer"),              # newer wins
        ("r", 2, 3, "only-newer"),                                # nothing below: wins
        ("s", 1, 10, "base"), ("s", 2, 99, "newer"), ("s", 3, 1, "replace"),  # replace always wins
    ], "path string, priority int, mtime long, v string")
    out = overlay.layered_overlay(df, ["path"], newer=[2], ts="mtime")
    assert rows(out, "path", "v") == [("p", "base"), ("q", "newer"), ("r", "only-newer"), ("s", "replace")]


def test_overlay_adjacent_replace_groups_associative(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 3, "w"), ("b", 2, "u")],
                               "path string, priority int, v string")
    whole = overlay.layered_overlay(df, ["path"])
    first = overlay.layered_overlay(df.where("priority <= 2"), ["path"])
    staged = overlay.layered_overlay(first.unionByName(df.where("priority = 3")), ["path"])
    assert rows(whole) == rows(staged)


def test_flatten_equal_base_names_newer_wins(spark):
    df = spark.createDataFrame([("a/x.jar", 1), ("b/x.jar", 2), ("c/y.jar", 1)], "path string, mtime long")
    out = overlay.flatten_to(df, "lib/")
    assert rows(out, "path", "source_path") == [("lib/x.jar", "b/x.jar"), ("lib/y.jar", "c/y.jar")]


def test_dedupe_first(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("h", 5, "c")], "k string, o int, v string")
    assert rows(overlay.dedupe_first(df, ["k"], ["o"]), "k", "v") == [("g", "a"), ("h", "c")]


# ---------------------------------------------------------------- versions
def _vk(spark, *vs):
    df = spark.createDataFrame([(v,) for v in vs], "v string")
    return df.select(vfn.version_key("v").alias("k")).collect()


def test_version_key_order(spark):
    k = [r.k for r in _vk(spark, "10.2", "9.12", "1.0-SNAPSHOT", "1.0", "1.0.0", "1.x", "1.0-rc1", "1.0-beta")]
    assert k[0] > k[1]                  # 10.2 > 9.12
    assert k[2] < k[3]                  # snapshot before release
    assert k[3] == k[4]                 # trailing zeros ignored
    assert k[5] is None                 # non-numeric part: null range
    assert k[7] < k[6] < k[3]           # beta < rc < release


def test_reconcile_null_range_copies_without_delete(spark):
    cand = spark.createDataFrame([("g", "a", "x.y"), ("g", "b", "2.0"), ("g", "c", "1.0"), ("g", "d", "1")],
                                 "group_id string, artifact_id string, version string")
    cur = spark.createDataFrame([("g", "a", "1.0"), ("g", "b", "1.0"), ("g", "c", "1.0.0")],
                                "group_id string, artifact_id string, version string")
    plan = versions.version_reconcile(cand, cur, ["group_id", "artifact_id"])
    assert rows(plan, "artifact_id", "action", "version") == [
        ("a", "COPY", "x.y"), ("b", "COPY", "2.0"), ("b", "DELETE", "1.0"), ("c", "SKIP", "1.0"),
        ("d", "COPY", "1")]
    state = versions.apply_plan(cur, plan, ["group_id", "artifact_id"])
    assert rows(state, "artifact_id", "version") == [("a", "1.0"), ("a", "x.y"), ("b", "2.0"), ("c", "1.0.0"),
                                                     ("d", "1")]


def test_version_from_hyphens(spark):
    df = spark.createDataFrame([("sql/a.sql",), ("sql/a-1.sql",), ("sql/a-1.0-2.0.sql",), ("sql/a-1-2-3.sql",),
                                ("bar-x/sql/update_db_foo-1.0.0",)], "p string")
    out = df.select("p", vfn.version_from("p").alias("f"), vfn.version_from("p", use_path=True).alias("u"))
    got = {r.p: (r.f, r.u) for r in out.collect()}
    assert got["sql/a.sql"] == (None, None)
    assert got["sql/a-1.sql"] == (None, None)
    assert got["sql/a-1.0-2.0.sql"] == ("1.0", "1.0")
    assert got["sql/a-1-2-3.sql"] == ("1-2", "1-2")
    assert got["bar-x/sql/update_db_foo-1.0.0"] == (None, "x/sql/update_db_foo")


def test_archive_name_12_hour_clock(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-05 15:07:00' AS ts")
    out = df.select(vfn.archive_name(F.lit("app"), F.lit(None).cast("string"), F.lit("1.0"), "ts", "zip")
                    .alias("n")).first().n
    assert out == "app-1.0-240305-0307.zip"


# ---------------------------------------------------------------- artifacts
def test_null_scope_passes_negative_fails_positive(spark):
    df = spark.createDataFrame([("jar", None, "x")], "type string, scope string, artifact_id string")
    assert artifacts.direct_dependency(df).count() == 1
    assert artifacts.transitive_dependency(df).count() == 1
    assert artifacts.third_party(df).count() == 0


def test_cardinality_zero_one_two(spark):
    expected = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "project string")
    cores = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "project string")
    out = quality.cardinality_check(cores, ["project"], expected=expected, max_count=1)
    assert rows(out, "project", "n", "ok") == [("p0", 0, True), ("p1", 1, True), ("p2", 2, False)]


def test_vendor_route(spark):
    df = spark.createDataFrame([("none",), ("auto",), ("mysql",), ("db2",)], "vendor string")
    out = artifacts.vendor_route(df, "vendor", F.lit("oracle"))
    assert rows(out, "vendor", "target_vendor", "route_status") == [
        ("auto", "oracle", "ROUTED"), ("db2", None, "ERROR"), ("mysql", "mysql", "ROUTED"), ("none", None, "PASS")]


# ----------------------------------------------------------------- scripts
def test_keyword_boundary_is_unicode_aware(spark):
    df = spark.createDataFrame([("éselect x",), ("a select",), ("-- drop it",), ("selection",)], "c string")
    got = [r.h for r in df.select(text.has_sql_orders("c").alias("h")).collect()]
    assert got == [False, True, True, False]


def test_blank_is_jvm_trim(spark):
    df = spark.createDataFrame([("",), (" \t\n\r\x0b",), ("\u00a0",), ("x",)], "c string")
    assert [r.b for r in df.select(text.is_blank("c").alias("b")).collect()] == [True, True, False, False]


def test_untagged_with_compact_comments_settles_in_two_passes(spark):
    content = "CREATE TABLE t (a int);\n--changeset later\n"
    df = spark.createDataFrame([("sql/create_t.sql", content, "plug")], "path string, content string, component string")
    p1 = scripts.process_scripts(df)
    assert p1.first().action == "TAGGED"
    p2 = scripts.process_scripts(p1.drop("action"))
    assert p2.first().action == "FIXED"
    p3 = scripts.process_scripts(p2.drop("action"))
    assert p3.first().action == "UNCHANGED"
    assert p3.first().content.startswith("-- liquibase formatted sql\n-- changeset plug:create_t.sql\n")


def test_fix_comments_idempotent(spark):
    df = spark.createDataFrame([("--liquibase formatted sql\n--changeset a:b\n--preconditions x\n--other",)], "c string")
    once = df.select(text.fix_comments("c").alias("c"))
    twice = once.select(text.fix_comments("c").alias("c"))
    assert once.first().c == twice.first().c == "-- liquibase formatted sql\n-- changeset a:b\n-- preconditions x\n--other"


def test_gate_and_readiness(spark):
    df = spark.createDataFrame([
        ("sql/create_a.sql", "-- liquibase formatted sql\nselect 1;"),
        ("sql/create_b.sql", "select 1;"),
        ("sql/notes.sql", "select 1;"),          # unmanaged: dropped, never reported
        ("sql/create_c.sql", ""),                # empty: dropped
        ("sql/init_d.sql", None),                # unreadable: rejected
        ("sql/build.properties", "x=1"),
    ], "path string, content string")
    g = scripts.gate_scripts(df)
    assert rows(g, "path", "gate") == [("sql/build.properties", "PASS"), ("sql/create_a.sql", "PASS"),
                                       ("sql/create_b.sql", "REJECT"), ("sql/create_c.sql", "DROP"),
                                       ("sql/init_d.sql", "REJECT"), ("sql/notes.sql", "DROP")]
    r = quality.readiness(g, rejected=F.col("gate") == "REJECT").first()
    assert (r.ready, r.n_rejected) == (False, 2)
    none = quality.readiness(g.where("gate = 'PASS'"), rejected=F.col("gate") == "REJECT").first()
    assert (none.ready, none.n_rejected) == (True, 0)


def test_lines_terminators(spark):
    df = spark.createDataFrame([("a\r\nb\rc",), ("a\n\n",), ("a",), ("",), ("a\n",)], "c string")
    out = df.select(text.map_lines("c", lambda line: F.upper(line)).alias("m"), text.last_line("c").alias("l"))
    got = [(r.m, r.l) for r in out.collect()]
    assert got == [("A\nB\nC\n", "c"), ("A\n\n", ""), ("A\n", "a"), ("", ""), ("A\n", "a")]


def test_substitute_and_normalize(spark):
    df = spark.createDataFrame([("\\C:\\x\\y\\", "a@b@")], "p string, s string")
    r = df.select(text.normalize_path("p").alias("n"), text.substitute("s", "Z", "@").alias("s")).first()
    assert (r.n, r.s) == ("C:/x/y", "aZbZ")


# ----------------------------------------------------------------- patterns
def test_glob_semantics():
    import re
    m = lambda g, p: re.fullmatch(globs.glob_to_regex(g)[1:-1], "/" + p) is not None
    assert m("**/package.html", "package.html") and m("**/package.html", "a/b/package.html")
    assert m("*.*", "a.txt") and not m("*.*", "d/a.txt")
    assert m("WEB-INF/lib/**", "WEB-INF/lib/x.jar") and not m("WEB-INF/lib/**", "w/WEB-INF/lib/x.jar")
    assert m("**/sql/**", "sql/a.sql") and m("**/sql/**", "x/sql/y/a.sql") and not m("**/sql/**", "xsql/a")
    assert not m("**/create*.sql", "create_a.SQL")


def test_path_exclude_prunes_svn_and_tech(spark):
    df = spark.createDataFrame([("a/.svn/x",), ("a/tech/x",), ("a/technical/x",), ("src/xdoc/a.xml",),
                                ("src/xdoc/sub/a.xml",), ("a/site/site.xml",), ("keep.txt",)], "p string")
    assert rows(patterns.path_exclude(df, "p")) == [("a/technical/x",), ("keep.txt",), ("src/xdoc/sub/a.xml",)]
    win = spark.createDataFrame([("a\\.svn\\x",), ("a\\b",)], "p string")
    assert rows(patterns.path_exclude(win, "p", separator="\\")) == [("a\\b",)]


def test_purge_roots_table_matches_literal(spark):
    df = spark.createDataFrame([("t/a",), ("t",), ("tx/a",), ("u/t/a",)], "p string")
    roots = spark.createDataFrame([("t/",)], "root string")
    assert rows(patterns.purge(df, "p", roots)) == rows(patterns.purge(df, "p", ["t"])) == [("tx/a",), ("u/t/a",)]


def test_package_membership_duplicates_resolved_by_rule_order(spark):
    df = spark.createDataFrame([("a/x.txt", "core"), ("x.txt", "core")], "path string, layer string")
    rules = [dict(package="p", include=["a/*"], entry_prefix="", rule_order=1),
             dict(package="p", include=["*.txt"], entry_prefix="a/", rule_order=2)]
    out = patterns.package_membership(df, rules)
    assert rows(out, "package", "entry_path", "source_path") == [("p", "a/x.txt", "x.txt")]


def test_or_default(spark):
    empty = spark.createDataFrame([], "package string, entry_path string")
    assert rows(packages.or_default(empty, {"package": "d"})) == [("d", None)]
    one = spark.createDataFrame([("x", "e")], "package string, entry_path string")
    assert rows(packages.or_default(one, {"package": "d"})) == [("x", "e")]


# ------------------------------------------------------------- descriptors
def test_descriptors_first_last_missing_malformed_duplicates(spark):
    df = spark.createDataFrame([
        ("1", "<p><name>a</name><x><name>b</name></x><db-pool-required>1</db-pool-required></p>"),
        ("2", "<p><version>1</version></p>"),
        ("3", "<p><name>a</name>"),
        ("4", "<p><name>a</name></p>"),
    ], "path string, xml string")
    p = descriptors.parse_descriptors(df, which="first")
    assert rows(p, "path", "valid", "name", "db_required") == [
        ("1", True, "a", True), ("2", True, None, False), ("3", False, None, False), ("4", True, "a", False)]
    st = descriptors.plugin_state(df)
    assert rows(st, "path", "key", "value") == [("1", "b.installed", "1"), ("1", "b.pool", "portal"),
                                                ("4", "a.installed", "1")]
    assert rows(descriptors.descriptor_rejects(df), "path", "reason") == [("2", "NO_NAME"), ("3", "MALFORMED")]


def test_allowed_values_reject_and_raise(spark):
    import pytest
    df = spark.createDataFrame([("war",), ("jar",)], "packaging string")
    rej = quality.allowed_values(df, "packaging", ["war"], on_fail="reject")
    assert rows(rej, "packaging") == [("jar",)]
    with pytest.raises(Exception):
        quality.allowed_values(df, "packaging", ["war"], on_fail="raise").collect()


def test_observe_counters_and_assert_cardinality(spark):
    import pytest
    df = spark.createDataFrame([("a", "NEW"), ("b", "UPDATED"), ("c", "NEW")], "k string, action string")
    observed, obs = quality.observe_counters(df, "sync")
    observed.write.format("noop").mode("overwrite").save()
    m = obs.get
    assert (m["rows"], m["new"], m["updated"]) == (3, 2, 1)
    ok = quality.cardinality_check(df, ["k"], max_count=1)
    assert quality.assert_cardinality(ok).count() == 3
    bad = quality.cardinality_check(df.unionByName(df), ["k"], max_count=1)
    with pytest.raises(Exception):
        quality.assert_cardinality(bad, "more than one").collect()


def test_readiness_state_rows(spark):
    df = spark.createDataFrame([("b.sql",), ("a.sql",)], "path string")
    st = quality.readiness_state(quality.readiness(df), df)
    assert rows(st) == [("liquibase.fileErrors", "a.sql"), ("liquibase.fileErrors", "b.sql"), ("liquibase.readyToRun", "false")]


def test_cardinality_core_project_exempt(spark):
    cores = spark.createDataFrame([("a-core",), ("a-core",), ("p",), ("p",)], "project string")
    out = quality.cardinality_check(cores, ["project"], max_count=1, exempt=F.col("project") == "a-core")
    assert rows(out, "project", "ok") == [("a-core", True), ("p", False)]


def test_overlay_decisions_marks_losers(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "path string, priority int, v string")
    assert rows(overlay.overlay_decisions(df, ["path"]), "path", "v", "won") == [
        ("a", "x", False), ("a", "y", True), ("b", "z", True)]


def test_sync_into_rewrites_only_touched_buckets(spark, tmp_path):
    import os
    state = str(tmp_path / "state")
    tgt = spark.createDataFrame([(f"k{i}", 1, "t") for i in range(40)], EV)
    sync.sync_into(tgt, state, ["k"], "ts", buckets=16)
    before = {d: sorted(os.listdir(f"{state}/{d}")) for d in os.listdir(state) if d.startswith("_bucket=")}
    src = spark.createDataFrame([("k3", 2, "s"), ("k3", 1, "x"), ("new", 1, "s")], EV)
    sync.sync_into(src, state, ["k"], "ts", buckets=16)
    got = spark.read.parquet(state).select("k", "ts", "v")
    expected = sync.incremental_sync(src, tgt, ["k"], "ts")
    assert rows(got) == rows(expected)
    touched = {r[0] for r in src.select(sync.key_bucket(["k"], 16)).collect()}
    after = {d: sorted(os.listdir(f"{state}/{d}")) for d in os.listdir(state) if d.startswith("_bucket=")}
    for d, files in before.items():
        if int(d.split("=")[1]) not in touched:
            assert after[d] == files          # untouched buckets: same files


def test_deploy_scripts_routes_and_rewrites(spark):
    tagged = "-- liquibase formatted sql\nselect  1;   \n"
    df = spark.createDataFrame([("sql/create_a.sql", tagged, "mysql"), ("sql/create_b.sql", tagged, "none"),
                                ("sql/create_c.sql", tagged, "db2"), ("sql/create_d.sql", "select 1;", "mysql")],
                               "path string, content string, vendor string")
    rules = [dict(vendor="mysql", rule_order=1, pattern=" {2,}", replacement=" ")]
    out = scripts.deploy_scripts(df, rules, requested="vendor")
    got = {r.path: (r.target_vendor, r.route_status, r.content) for r in out.collect()}
    assert got["sql/create_a.sql"] == ("mysql", "ROUTED", "-- liquibase formatted sql\nselect 1; \n")
    assert got["sql/create_b.sql"] == (None, "PASS", tagged)            # unrouted: bytes unchanged
    assert got["sql/create_c.sql"][1] == "ERROR"                        # unknown vendor reported
    assert "sql/create_d.sql" not in got                                # untagged: rejected by the gate


def test_overlay_newer_as_mapping_equals_list(spark):
    df = spark.createDataFrame([("p", 1, 10, "a"), ("p", 2, 11, "b"), ("q", 2, 1, "c"), ("q", 3, 0, "d")],
                               "path string, priority int, mtime long, v string")
    a = overlay.layered_overlay(df, ["path"], newer={2: "newer", 1: "replace", 3: "replace"}, ts="mtime")
    b = overlay.layered_overlay(df, ["path"], newer=[2], ts="mtime")
    assert rows(a) == rows(b) == [("p", 2, 11, "b"), ("q", 3, 0, "d")]


def test_sync_stamp_marks_copy_time(spark):
    tgt = spark.createDataFrame([("a", 5, "t"), ("b", 5, "t")], EV)
    src = spark.createDataFrame([("a", 7, "s"), ("b", 1, "s")], EV)
    out = sync.incremental_sync(src, tgt, ["k"], "ts", stamp=F.lit(100).cast("long"))
    assert rows(out) == [("a", 100, "s"), ("b", 5, "t")]


def test_or_default_per_group_and_rejected_paths(spark):
    keys = spark.createDataFrame([("p1",), ("p2",)], "package string")
    matches = spark.createDataFrame([("p1", "a.sql")], "package string, entry string")
    out = packages.or_default_per_group(keys, matches, ["package"], {"entry": F.lit("<none>")})
    assert rows(out) == [("p1", "a.sql"), ("p2", "<none>")]
    df = spark.createDataFrame([("b", True), ("a", True), ("c", False)], "path string, bad boolean")
    assert [r.path for r in quality.rejected_paths(df, rejected=F.col("bad")).collect()] == ["a", "b"]


def test_sync_into_writes_one_file_per_bucket(spark, tmp_path):
    import os
    state = str(tmp_path / "state")
    df = spark.range(2000).selectExpr("CAST(id AS STRING) AS k", "id AS ts", "'v' AS v").repartition(8)
    sync.sync_into(df, state, ["k"], "ts", buckets=16)
    for d in os.listdir(state):
        if d.startswith("_bucket="):
            assert len([f for f in os.listdir(f"{state}/{d}") if f.endswith(".parquet")]) == 1


def test_closure_salts_hot_parents_same_result(spark):
    from strata.operators import closure
    # node 0 has 3000 children (a hot parent); chains hang below some of them; a cycle back to 0
    edges = spark.range(1, 3001).selectExpr("0L AS parent", "id AS child").unionByName(
        spark.range(1, 3001).selectExpr("id AS parent", "id + 10000 AS child")).unionByName(
        spark.createDataFrame([(10005, 0)], "parent long, child long"))
    roots = spark.createDataFrame([(0,)], "node long")
    plain = closure.dependency_closure(roots, edges)
    salted = closure.dependency_closure(roots, edges, hot_degree=100)
    assert rows(plain) == rows(salted)
    assert len(rows(plain)) == 6001
    assert {r.depth for r in salted.collect()} == {0, 1, 2}


def test_readiness_has_no_bound(spark):
    df = spark.range(200_000).selectExpr("CAST(id AS STRING) AS path")
    r = quality.readiness(df).first()
    assert (r.ready, r.n_rejected) == (False, 200_000)
    assert quality.rejected_paths(df).count() == 200_000


def test_sync_into_keeps_state_columns(spark, tmp_path):
    state = str(tmp_path / "state")
    sync.sync_into(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, ts long, extra string"), state, ["k"], "ts", buckets=2)
    sync.sync_into(spark.createDataFrame([("a", 2), ("c", 1)], "k string, ts long"), state, ["k"], "ts", buckets=2)      # fewer columns
    sync.sync_into(spark.createDataFrame([("b", 3, "z", 7)], "k string, ts long, extra string, more int"), state, ["k"], "ts", buckets=2)
    got = spark.read.option("mergeSchema", "true").parquet(state).select("k", "ts", "extra", "more")
    assert rows(got) == [("a", 2, "x", None), ("b", 3, "z", 7), ("c", 1, None, None)]


def test_closure_nulls_chain_and_deep_graph(spark):
    from strata.operators import closure
    edges = spark.createDataFrame([(1, 2), (2, None), (2, 3), (None, 9), (3, 1)], "parent long, child long")
    out = closure.dependency_closure(spark.createDataFrame([(1,), (None,)], "node long"), edges)
    assert rows(out) == [(1, 0), (2, 1), (3, 2)]
    chain = spark.range(60).selectExpr("id AS parent", "id + 1 AS child")
    deep = closure.dependency_closure(spark.createDataFrame([(0,)], "node long"), chain)
    assert sorted((r.node, r.depth) for r in deep.collect()) == [(i, i) for i in range(61)]


def test_version_key_qualifiers_and_long_numbers(spark):
    k = [r.k for r in _vk(spark, "5.4.0.Final", "4.1.0.RELEASE", "2.0.20230101123456", "1.0b2", "1.0-jre", "1.0-android", "5.4", "1.0-beta2")]
    assert None not in k
    assert k[0] == k[6] and k[3] == k[7]
    assert k[4] > k[5]                  # unknown words order by their text
    assert k[2] > k[3]


def test_apply_plan_deletes_a_null_version(spark):
    state = spark.createDataFrame([("a", None), ("b", "1")], "k string, version string")
    plan = spark.createDataFrame([("a", "DELETE", None), ("a", "COPY", "2")], "k string, action string, version string")
    assert rows(versions.apply_plan(state, plan, ["k"])) == [("a", "2"), ("b", "1")]


def test_overlay_decisions_null_keys_and_copies(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("p", 1, "c"), ("p", 1, "c")], "path string, priority int, v string")
    out = overlay.overlay_decisions(df, ["path"])
    assert sorted(rows(out), key=str) == sorted([(None, 1, "a", False), (None, 2, "b", True), ("p", 1, "c", True), ("p", 1, "c", False)], key=str)


def test_globs_directory_and_empty_include(spark):
    df = spark.createDataFrame([("dir/a/b",), ("dir/c",), ("other",)], "path string")
    assert rows(patterns.glob_filter(df, "path", ["dir/"])) == [("dir/a/b",), ("dir/c",)]
    assert rows(patterns.glob_filter(df, "path", [], ["other"])) == [("dir/a/b",), ("dir/c",)]


def test_build_properties_follow_the_route(spark):
    df = spark.createDataFrame([("a/build.properties", "x=1", "mysql"), ("b/build.properties", "x=1", "none")], "path string, content string, vendor string")
    out = scripts.deploy_scripts(df, [dict(vendor="mysql", pattern="1", replacement="2")], requested="vendor")
    assert rows(out, "path", "content") == [("b/build.properties", "x=1")]


def test_unmanaged_scripts_are_rejected_rows(spark):
    df = spark.createDataFrame([("x/notes.sql", "select 1;"), ("x/create_a.sql", "select 1;")], "path string, content string")
    out = scripts.process_scripts(df, component=None, managed=True)
    assert rows(out, "path", "action") == [("x/create_a.sql", "TAGGED"), ("x/notes.sql", "REJECTED")]


def test_descriptors_that_are_not_one_document(spark):
    bad = ["<p><name>a</name></p> x", "<p/><p/>", "\ufeff<p/>", "<p>", "", None]
    df = spark.createDataFrame([(b,) for b in [*bad, "<p><name>a<b>c</b></name></p>"]], "xml string")
    out = descriptors.parse_descriptors(df)
    assert sorted(((r.valid, r["name"]) for r in out.collect()), key=str) == [(False, None)] * 6 + [(True, "ac")]
    extra = descriptors.one_per_component(spark.createDataFrame([("b", "k"), ("a", "k"), ("c", None)], "path string, comp string"), "comp")
    assert sorted(rows(extra, "path", "extra")) == [("a", False), ("b", True), ("c", False)]


def test_purge_by_root_table(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("a/bb/c.txt",), ("a/b",), ("x",), (None,)], "path string")
    roots = spark.createDataFrame([("a/b/",), ("x",)], "root string")
    assert sorted(rows(patterns.purge(df, "path", roots)), key=str) == [("a/bb/c.txt",), (None,)]


def _bfs(roots, edges):
    depth, line = {r: 0 for r in roots if r is not None}, [r for r in roots if r is not None]
    children = {}
    for a, b in edges:
        if a is not None and b is not None:
            children.setdefault(a, set()).add(b)
    for x in line:
        for y in children.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                line.append(y)
    return sorted(depth.items())


@pytest.mark.parametrize("growth, hot", [(1, 100_000), (32, 100_000), (8, 2)])
def test_closure_of_random_graphs_equals_brute_force(spark, growth, hot):
    from strata.operators import closure
    rng = random.Random(growth + hot)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(90)]                      # any
    edges += [(100 + i, 101 + i) for i in range(40)] + [(5, 100), (120, 100), (139, 2)]      # a chain with a way back into it
    edges += [(200 + i // 2, 201 + i) for i in range(60)] + [(7, 200)]                       # a tree
    edges += [(300 + i, 300 + (i + 1) % 9) for i in range(9)]                                # a cycle that nothing leads to
    edges += [(400 + 2 * i + a, 402 + 2 * i + b) for i in range(12) for a in (0, 1) for b in (0, 1)] + [(0, 400)]  # a ladder
    edges += edges[:20] + [(1, 1), (None, 3), (3, None)]
    roots = [0, 5, 0, None, 210, 999]
    out = closure.dependency_closure(spark.createDataFrame([(r,) for r in roots], "node long"), spark.createDataFrame(edges, "parent long, child long"),
                                     growth=growth, hot_degree=hot)
    assert sorted((r.node, r.depth) for r in out.collect()) == _bfs(roots, edges)


@pytest.mark.parametrize("graph, limit", [("chain", 40), ("tree of chains", 40), ("ring", 40)])
def test_closure_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch, graph, limit):
    from strata.operators import closure
    edges = [(i, i + 1) for i in range(10_000)]
    edges += [(100 * i, 100_000 + i) for i in range(100)] if graph == "tree of chains" else [(10_000, 0)] if graph == "ring" else []
    names, real = [], closure._counted
    monkeypatch.setattr(closure, "_counted", lambda df, name, *more: (names.append(name), real(df, name, *more))[1])
    out = closure.dependency_closure(spark.createDataFrame([(0,)], "node long"), spark.createDataFrame(edges, "parent long, child long"))
    assert sorted((r.node, r.depth) for r in out.collect()) == _bfs([0], edges)
    assert len(names) < limit


def test_closure_of_nothing(spark):
    from strata.operators import closure
    none, edge = spark.createDataFrame([], "node long"), spark.createDataFrame([(1, 2)], "parent long, child long")
    assert closure.dependency_closure(none, edge).count() == 0
    assert rows(closure.dependency_closure(spark.createDataFrame([(1,), (8,)], "node long"), edge.limit(0))) == [(1, 0), (8, 0)]
    assert rows(closure.dependency_closure(spark.createDataFrame([(1,), (2,)], "node long"), edge, stop=F.col("node") == 2)) == [(1, 0)]
