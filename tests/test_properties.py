"""Property tests: glob translation against a brute-force matcher; idempotence."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from strata.functions import globs, text
from strata.operators import overlay, sync

SEG = st.sampled_from(["a", "b", "x.y", ".svn", "sql", "c.sql", "WEB-INF", "lib"])
GSEG = st.sampled_from(["a", "b", "*", "**", "*.sql", "?", "sql", ".svn", "x.*", "WEB-INF", "lib"])


def brute(glob: str, path: str) -> bool:
    """Segment-wise matcher written independently of the regex translator."""
    gs, ps = glob.split("/"), path.split("/")

    def seg_ok(g, p):
        rx = "".join("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch) for ch in g)
        return re.fullmatch(rx, p) is not None

    def go(i, j):
        if i == len(gs):
            return j == len(ps)
        if gs[i] == "**":
            return any(go(i + 1, k) for k in range(j, len(ps) + 1))
        return j < len(ps) and seg_ok(gs[i], ps[j]) and go(i + 1, j + 1)
    return go(0, 0)


@settings(max_examples=400, deadline=None)
@given(st.lists(GSEG, min_size=1, max_size=4), st.lists(SEG, min_size=1, max_size=4))
def test_glob_regex_equals_brute_force(gparts, pparts):
    g, p = "/".join(gparts), "/".join(pparts)
    assert (re.fullmatch(globs.glob_to_regex(g)[1:-1], "/" + p) is not None) == brute(g, p), (g, p)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 3), st.sampled_from("xyz")), max_size=8),
       st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 3), st.sampled_from("xyz")), max_size=8))
def test_sync_idempotent_and_never_deletes(spark, src_rows, tgt_rows):
    schema = "k string, ts int, v string"
    src = sync.latest_per_key(spark.createDataFrame(src_rows, schema), ["k"], "ts", ["v"])
    tgt = sync.latest_per_key(spark.createDataFrame(tgt_rows, schema), ["k"], "ts", ["v"])
    once = sync.incremental_sync(src, tgt, ["k"], "ts")
    twice = sync.incremental_sync(src, once, ["k"], "ts")
    assert rows(once) == rows(twice)
    assert {r[0] for r in rows(tgt)} <= {r[0] for r in rows(once)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pq"), st.integers(1, 4), st.integers(0, 9)), min_size=1, max_size=10))
def test_overlay_matches_python(spark, data):
    df = spark.createDataFrame(data, "path string, priority int, t int")
    got = rows(overlay.layered_overlay(df, ["path"], tiebreak=["t"]))
    want = sorted({p: max(r for r in data if r[0] == p)[0:3] for p, _, _ in data}.values(), key=repr)
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["--changeset a", "--preconditions b", "--liquibase formatted sql", "-- x",
                                 "select 1", "", "--changesetx"]), max_size=5))
def test_fix_comments_idempotent(spark, lines):
    c = "\n".join(lines)
    df = spark.createDataFrame([(c,)], "c string")
    once = df.select(text.fix_comments("c").alias("c"))
    assert once.first().c == once.select(text.fix_comments("c").alias("c")).first().c
    assert not once.select(text.needs_fixing("c").alias("n")).first().n


QUALS = {"alpha": 1, "beta": 2, "milestone": 3, "rc": 4, "snapshot": 5, "": 6}
VERSION = st.tuples(st.lists(st.integers(0, 12), min_size=1, max_size=4),
                    st.sampled_from(list(QUALS))).map(
    lambda t: ".".join(map(str, t[0])) + (f"-{t[1]}" if t[1] else ""))


def py_key(v: str):
    """Independent model of the version order: numbers without trailing zeros, then qualifier rank."""
    base, _, qual = v.partition("-")
    nums = [int(x) for x in base.split(".")]
    while len(nums) > 1 and nums[-1] == 0:
        nums.pop()
    return (nums, QUALS[qual.lower()])


@settings(max_examples=10, deadline=None)
@given(st.lists(VERSION, min_size=2, max_size=12))
def test_version_key_order_matches_model(spark, vs):
    from strata.functions.versions import version_key
    df = spark.createDataFrame([(v,) for v in vs], "v string")
    got = {r.v: r.k for r in df.select("v", version_key("v").alias("k")).collect()}
    for a in vs:
        for b in vs:
            ka, kb = got[a], got[b]
            assert (ka < kb) == (py_key(a) < py_key(b)), (a, b)
            assert (ka == kb) == (py_key(a) == py_key(b)), (a, b)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), VERSION), max_size=6),
       st.lists(st.tuples(st.sampled_from("abcd"), VERSION), min_size=1, max_size=6))
def test_apply_plan_leaves_one_version_per_key(spark, cur_rows, cand_rows):
    from strata.operators import versions
    schema = "group_id string, artifact_id string, version string"
    cur = spark.createDataFrame([("g", k, v) for k, v in cur_rows], schema)
    cur = versions.max_version(cur, ["group_id", "artifact_id"]).withColumnRenamed("max_version", "version")
    cand = spark.createDataFrame([("g", k, v) for k, v in cand_rows], schema)
    plan = versions.version_reconcile(cand, cur, ["group_id", "artifact_id"])
    state = versions.apply_plan(cur, plan, ["group_id", "artifact_id"])
    per_key = {}
    for r in state.collect():
        per_key.setdefault(r.artifact_id, []).append(r.version)
    assert all(len(v) == 1 for v in per_key.values()), per_key
    for k in {k for k, _ in cand_rows}:          # the state holds the newest of both sides
        best = max([v for kk, v in cand_rows if kk == k] + [v for kk, v in cur_rows if kk == k], key=py_key)
        assert py_key(per_key[k][0]) == py_key(best)
