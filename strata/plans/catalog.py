"""Registered queries: one per operator, each reading whole provided tables.

Each query is ``(spark, sf_dir) -> DataFrame``. Computed columns are aliased
to the names used by the matching oracle in ``strata.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import globs, text
from strata.functions import versions as vfn
from strata.operators import (artifacts, closure, descriptors, overlay, packages, patterns, quality, scripts,
                              sync, versions)
from strata.operators import assemble as assemble_op
from strata.plans.fixtures import FIXTURES, fixture
from strata.session import scratch_path, written
from strata.sources import files, sinks
from strata.sources.tables import table
from strata.sources.text_files import remove_spare_files, remove_text_files, write_text_files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ROUND_BYTES = 1 << 30  # disk of the files of one round, if their texts have less
FILE_BLOCK, INODE = 4096, 1024

LAYER_KEY = ("l_orderkey", "l_linenumber")
LAYER_TIEBREAK = ("l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice")


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def _tree(spark, df, name, spare=None):
    """Each row of ``path, content`` as a file at its path. A table in fewer splits
    than there are cores is dealt over all of them: rows are small, files are many."""
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, "path")
    return write_text_files(df, scratch_path(spark, name), spare=spare)


def _over_tree(spark, df, name, job, back=None):
    """What ``job`` (root -> rows) makes of a tree with each row of ``path, content`` as
    a file at its path.

    A file takes a block and an inode however short it is, so paths are dealt into
    rounds whose files take ``ROUND_BYTES``, or as much as all texts have if that is
    more: every row is written as a file, gone over by ``job`` and removed before the
    next round is written, over the spare files of the last. Rows of one path meet in one round. ``job`` must treat paths one by one;
    ``back`` is its own folder of spare files, if it writes."""
    df = df.select("path", F.col("content").cast("string").alias("content"))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    total = df.agg(F.sum(F.ceil(size / FILE_BLOCK) * FILE_BLOCK + INODE).alias("disk"), F.sum(size).alias("texts")).first()
    rounds = -(-(total["disk"] or 0) // max(ROUND_BYTES, total["texts"] or 0))
    if rounds <= 1:
        return job(_tree(spark, df, name))
    key, slots = F.xxhash64("path"), 4 * spark.sparkContext.defaultParallelism  # a round in as many files as keep all cores at work
    dealt = df.withColumns({"round": F.pmod(key, F.lit(rounds)).cast("int"), "slot": F.pmod(F.shiftright(key, 32), F.lit(slots))}).hint("rebalance", "round", "slot").drop("slot")
    dealt = written(dealt, name + "-dealt", "round")
    out, spare = scratch_path(spark, name + "-rows"), scratch_path(spark, name + "-spare")
    for k in range(rounds):
        part = dealt.where(F.col("round") == k).select("path", "content")
        root = _tree(spark, part, name, spare)
        found = job(root)
        found.write.mode("append").parquet(out)
        remove_text_files(part, root)
    for kept in filter(None, (spare, back)):
        remove_spare_files(spark, kept)
    return spark.read.schema(found.schema).parquet(out)


# ----------------------------------------------------------------- overlay
@register
def q_layered_overlay(spark, sf):
    """Last layer wins per (l_orderkey, l_linenumber); A < N < R."""
    return overlay.layered_overlay(fixture(spark, sf, "layers"), LAYER_KEY, tiebreak=LAYER_TIEBREAK)


@register
def q_overlay_newer(spark, sf):
    """A replace, N newer-wins on l_shipdate, R replace: one aggregate for the chain."""
    return overlay.layered_overlay(fixture(spark, sf, "layers"), LAYER_KEY, tiebreak=LAYER_TIEBREAK,
                                   newer=[2], ts="l_shipdate")


@register
def q_overlay_decisions(spark, sf):
    """Every layer row with won/lost (the overlay with its losers)."""
    return overlay.overlay_decisions(fixture(spark, sf, "layers"), LAYER_KEY, tiebreak=LAYER_TIEBREAK)


@register
def q_layer_counters(spark, sf):
    """Rows kept and overridden per layer."""
    d = overlay.overlay_decisions(fixture(spark, sf, "layers"), LAYER_KEY, tiebreak=LAYER_TIEBREAK)
    d = d.withColumn("action", F.when(F.col("won"), F.lit("KEPT")).otherwise(F.lit("OVERRIDDEN")))
    return quality.run_counters(d)


@register
def q_dedupe_first(spark, sf):
    """First shipment per part, in a total order."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey",
                                             "l_shipdate", "l_extendedprice", "l_quantity")
    return overlay.dedupe_first(li, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
                                                    "l_extendedprice", "l_quantity"])


@register
def q_union_layers(spark, sf):
    """Three differently shaped trees unioned by column name."""
    docs = fixture(spark, sf, "paths").select(F.lit("documents").alias("layer"), "path", "length")
    scr = fixture(spark, sf, "scripts").select(F.lit("scripts").alias("layer"),
                                               F.concat(F.lit("src/sql/"), "file_name").alias("path"), "component")
    dsc = fixture(spark, sf, "descriptors").select(F.lit("descriptors").alias("layer"), "path")
    return overlay.union_layers(docs, scr, dsc)


@register
def q_flatten_to(spark, sf):
    """All files put directly in WEB-INF/lib/ by base name; newer wins on collision."""
    p = fixture(spark, sf, "paths").select("path", "mtime", "doc_id")
    return overlay.flatten_to(p, "WEB-INF/lib/", tiebreak=["doc_id"])


# -------------------------------------------------------------------- sync
EVENT_KEY = ("user_id", "event_type")


def _event_pair(spark, sf):
    src = sync.latest_per_key(fixture(spark, sf, "events_source"), EVENT_KEY, "ts")
    tgt = sync.latest_per_key(fixture(spark, sf, "events_target"), EVENT_KEY, "ts")
    return src, tgt


@register
def q_incremental_sync(spark, sf):
    """Both sides as raw change rows: the sync keeps the newest row per key and
    side itself, so the whole merge is one shuffle."""
    src, tgt = fixture(spark, sf, "events_source"), fixture(spark, sf, "events_target")
    return sync.incremental_sync(src, tgt, EVENT_KEY, "ts")


@register
def q_sync_plan(spark, sf):
    src, tgt = fixture(spark, sf, "events_source"), fixture(spark, sf, "events_target")
    return sync.sync_plan(src, tgt, EVENT_KEY, "ts")


@register
def q_verify_copy(spark, sf):
    """Event id as the 'length': keys whose copies differ or are missing."""
    src, tgt = _event_pair(spark, sf)
    return sync.verify_copy(src.withColumnRenamed("event_id", "length"),
                            tgt.withColumnRenamed("event_id", "length"), EVENT_KEY)


@register
def q_run_counters(spark, sf):
    """Rows per (event_type, sync action)."""
    src, tgt = fixture(spark, sf, "events_source"), fixture(spark, sf, "events_target")
    return quality.run_counters(sync.sync_plan(src, tgt, EVENT_KEY, "ts"), layer="event_type")


@register
def q_written_counters(spark, sf):
    """The sync written once, its actions counted by the write."""
    src, tgt = fixture(spark, sf, "events_source"), fixture(spark, sf, "events_target")
    return quality.written_counters(sync.sync_plan(src, tgt, EVENT_KEY, "ts"), scratch_path(spark, "written-counters"))


# ---------------------------------------------------------------- versions
ART_KEY = ("group_id", "artifact_id")


def _version_sides(spark, sf):
    pv = fixture(spark, sf, "part_versions")
    # Candidates: brands 1-15 without 'cold' artifacts, and LARGE of the others; current: brands
    # 10-25 without LARGE, and the 'cold' artifacts left. Every part is on a side.
    cand = pv.where("(brand_no <= 15 AND artifact_id NOT LIKE 'cold%') OR (brand_no > 15 AND group_id = 'LARGE')").select(*ART_KEY, "version")
    cur = pv.where("(brand_no >= 10 AND group_id <> 'LARGE') OR (brand_no <= 15 AND artifact_id LIKE 'cold%')").select(*ART_KEY, "version")
    return cand, cur


@register
def q_version_reconcile(spark, sf):
    cand, cur = _version_sides(spark, sf)
    return versions.version_reconcile(cand, cur, ART_KEY)


@register
def q_apply_plan(spark, sf):
    cand, cur = _version_sides(spark, sf)
    return versions.apply_plan(cur, versions.version_reconcile(cand, cur, ART_KEY), ART_KEY)


@register
def q_accumulate(spark, sf):
    cand, cur = _version_sides(spark, sf)
    return versions.accumulate(cur, cand)


@register
def q_max_version(spark, sf):
    """Newest version per group, 'cold' artifacts excluded."""
    pv = fixture(spark, sf, "part_versions")
    return versions.max_version(pv, ["group_id"], exclude=F.col("artifact_id").startswith("cold"))


@register
def q_version_drift(spark, sf):
    """Groups whose newest candidate script exceeds the declared version (the newest
    current release)."""
    cand, cur = _version_sides(spark, sf)
    declared = versions.max_version(cur, ["group_id"]).withColumnRenamed("max_version", "declared_version")
    return versions.version_drift(cand, declared, ["group_id"])


@register
def q_version_key(spark, sf):
    pv = fixture(spark, sf, "part_versions")
    k = vfn.version_key("version")
    return pv.select("p_partkey", "version",
                     F.array_join(k["nums"].cast("array<string>"), ".").alias("key_numbers"), k["rank"].alias("key_rank"),
                     k["qnum"].cast("long").alias("key_qualifier_number"), k["qtext"].alias("key_text"),
                     vfn.release_version("version").alias("release_version"),
                     vfn.is_snapshot("version").alias("is_snapshot"))


@register
def q_remove_named(spark, sf):
    """Drop from WEB-INF/lib the jars of the DELETE rows of the reconcile plan."""
    cand, cur = _version_sides(spark, sf)
    jar = F.concat(F.col("artifact_id"), F.lit("-"), F.col("version"), F.lit(".jar"))
    files = cur.select(F.concat(F.lit("WEB-INF/lib/"), jar).alias("path")).distinct()
    plan = versions.version_reconcile(cand, cur, ART_KEY)
    names = plan.where(F.col("action") == versions.DELETE).select(jar.alias("name"))
    return versions.remove_named(files, names, "WEB-INF/lib")


# ---------------------------------------------------------------- patterns
def _paths(spark, sf):
    return fixture(spark, sf, "paths").select("doc_id", "path", "layer")


@register
def q_glob_filter(spark, sf):
    """The webapp packaging profile over all document paths."""
    return patterns.profile_filter(_paths(spark, sf), "path", "package_webapp")


@register
def q_pattern_profile(spark, sf):
    """Every profile over every path: one row per (profile, path) selected."""
    return patterns.profile_membership(_paths(spark, sf).drop("layer"), "path")


@register
def q_path_exclude(spark, sf):
    return patterns.path_exclude(_paths(spark, sf).drop("layer"), "path")


@register
def q_remap_prefix(spark, sf):
    return patterns.remap_prefix(_paths(spark, sf).drop("layer"), "path", "WEB-INF/sql/", "src/sql/")


@register
def q_relative_path(spark, sf):
    return patterns.relative_path(_paths(spark, sf).drop("layer"), "path", "webapp")


@register
def q_normalize_path(spark, sf):
    """Windows-style spellings of the paths, normalised back."""
    win = F.concat(
        F.when(F.col("doc_id") % 3 == 0, F.lit("\\C:\\")).otherwise(F.lit("")),
        F.replace(F.col("path"), F.lit("/"), F.lit("\\")),
        F.when(F.col("doc_id") % 2 == 0, F.lit("\\")).otherwise(F.lit("")))
    p = _paths(spark, sf).select("doc_id", win.alias("raw_path"))
    return p.withColumn("path", text.normalize_path("raw_path"))


@register
def q_has_extension(spark, sf):
    p = _paths(spark, sf)
    return p.select("doc_id", "path", text.has_extension("path", ".sql").alias("is_sql"),
                    text.has_extension("path", ".sql", case_sensitive=True).alias("is_sql_exact"),
                    text.has_extension("path", ".xml").alias("is_xml"))


@register
def q_extract_subtree(spark, sf):
    """webapp/WEB-INF/** re-rooted to WEB-INF/, replacing entries already there."""
    p = _paths(spark, sf).drop("layer")
    existing = p.where(F.col("path").startswith("WEB-INF/"))
    return patterns.extract_subtree(p, "path", "webapp/WEB-INF", "WEB-INF/", existing=existing)


@register
def q_purge(spark, sf):
    """Drop target/ and src/java/ trees, plus xml files other than plugin_1*."""
    return patterns.purge(_paths(spark, sf).drop("layer"), "path", ["target", "src/java"],
                          includes=["**/*.xml"], excludes=["**/plugin_1*.xml"])


@register
def q_purge_roots_table(spark, sf):
    """Roots as a table (every French source tree): ancestor equi-join, no nested loop."""
    docs = table(spark, sf, "documents")
    roots = docs.where(F.col("lang") == "fr").select(F.concat("source", F.lit("/fr")).alias("root"))
    return patterns.purge(_paths(spark, sf).drop("layer"), "path", roots)


def _profile_rule(package: str, profile: str, order: int, prefix: str = "", **more) -> dict:
    p = globs.PROFILES[profile]
    return dict(package=package, include=list(p["include"]), exclude=list(p["exclude"]), entry_prefix=prefix, rule_order=order, **more)


PACKAGE_RULES = (
    dict(package="webapp", include=["webapp/**"], exclude=["**/WEB-INF/classes/**"], entry_prefix="", rule_order=1),
    dict(package="webapp", include=["WEB-INF/lib/*.xml", "WEB-INF/lib/*.html"], entry_prefix="webapp/", rule_order=2),
    dict(package="sql", include=["**/*.sql", "**/*.SQL"], exclude=["**/.svn/**"], entry_prefix="sql/", rule_order=3),
    dict(package="site", layer="site", include=["**/user/**"], entry_prefix="", rule_order=4),
    _profile_rule("sources", "source_src", 5, "src-archive/"),
    _profile_rule("resources", "package_resources", 6),
)


@register
def q_package_membership(spark, sf):
    return patterns.package_membership(_paths(spark, sf), PACKAGE_RULES, tiebreak=["doc_id"])


@register
def q_package_membership_table(spark, sf):
    """The package rules as rows, and a rule for each source and language of the documents."""
    fixed = spark.createDataFrame([tuple(r.get(f) for f in patterns.RULE_FIELDS) for r in PACKAGE_RULES],
                                  "package string, layer string, include array<string>, exclude array<string>, entry_prefix string, rule_order int")
    each = table(spark, sf, "documents").select("source", "lang").distinct().select(
        F.concat_ws("-", F.lit("by"), "source", "lang").alias("package"), F.lit(None).cast("string").alias("layer"),
        F.array(F.concat_ws("/", "source", "lang", F.lit("**"))).alias("include"), F.array(F.lit("**/create*")).alias("exclude"),
        F.lit("").alias("entry_prefix"), F.lit(9).alias("rule_order"))
    return patterns.package_membership_by_table(_paths(spark, sf), fixed.unionByName(each), tiebreak=["doc_id"])


def _script_files(spark, sf):
    s = fixture(spark, sf, "scripts")
    return s.select(F.concat(F.lit("src/sql/plugins/"), "component", F.lit("/"), "file_name").alias("path"))


@register
def q_release_packages(spark, sf):
    return packages.release_packages(_paths(spark, sf), "2.0.0")


@register
def q_upgrade_packages(spark, sf):
    return packages.upgrade_packages(_script_files(spark, sf), "2.0.0", "1.0.0")


@register
def q_or_default(spark, sf):
    """The scripts that target 9.9.9, or one default row as there are none."""
    hits = _script_files(spark, sf).where(F.col("path").endswith("-9.9.9.sql"))
    return packages.or_default(hits, {"path": "none"})


@register
def q_upgrade_rejects(spark, sf):
    """Scripts to 2.0.0 whose name has no from-version."""
    return packages.upgrade_rejects(_script_files(spark, sf), "2.0.0")


@register
def q_upgrade_default(spark, sf):
    """No update script targets 9.9.9: one default upgrade package row."""
    return packages.upgrade_packages(_script_files(spark, sf), "9.9.9", "1.0.0")


# --------------------------------------------------------------- artifacts
def _artifacts(spark, sf):
    return fixture(spark, sf, "artifacts")


@register
def q_by_type(spark, sf):
    return artifacts.by_type(_artifacts(spark, sf), artifacts.PLUGIN_TYPE)


@register
def q_third_party(spark, sf):
    return artifacts.third_party(_artifacts(spark, sf))


@register
def q_direct_dependency(spark, sf):
    return artifacts.direct_dependency(_artifacts(spark, sf))


@register
def q_transitive_dependency(spark, sf):
    return artifacts.transitive_dependency(_artifacts(spark, sf))


@register
def q_multi_module_filter(spark, sf):
    return artifacts.multi_module_filter(_artifacts(spark, sf))


@register
def q_artifact_filter(spark, sf):
    """A caller's predicate: group g1, major version 3."""
    return artifacts.artifact_filter(_artifacts(spark, sf),
                                     lambda d: (d.group_id == "g1") & d.version.startswith("3."))


@register
def q_vendor_route(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id",
        F.expr("CASE event_type WHEN 'view' THEN 'mysql' WHEN 'click' THEN 'postgresql' WHEN 'purchase' THEN 'auto'"
               " WHEN 'signup' THEN 'none' ELSE 'sybase' END").alias("requested"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'oracle' END").alias("configured"))
    return artifacts.vendor_route(ev, "requested", "configured")


# ----------------------------------------------------------------- quality
@register
def q_cardinality_check(spark, sf):
    """Zero-or-one pending order per customer; every customer judged."""
    pending = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P") \
        .select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf, "customer").select("c_custkey")
    return quality.cardinality_check(pending, ["c_custkey"], expected=customers, min_count=0, max_count=1)


@register
def q_allowed_values(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return quality.allowed_values(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], on_fail="reject")


# ----------------------------------------------------------------- scripts
def _scripts(spark, sf):
    s = fixture(spark, sf, "scripts")
    return s.withColumn("path", F.concat(F.lit("src/sql/plugins/"), "component", F.lit("/"), "file_name"))


@register
def q_script_functions(spark, sf):
    s = _scripts(spark, sf)
    c = F.col("content")
    return s.select("o_orderkey", "path", text.is_blank(c).alias("is_blank"),
                    text.has_sql_orders(c).alias("has_sql_orders"), text.is_tagged(c).alias("is_tagged"),
                    text.first_line_tagged(c).alias("first_line_tagged"),
                    text.needs_fixing(c).alias("needs_fixing"), scripts.is_managed("path").alias("is_managed"),
                    text.script_action(c).alias("action"))


@register
def q_process_scripts(spark, sf):
    s = _scripts(spark, sf)
    return scripts.process_scripts(s, file_name="file_name").select("o_orderkey", "path", "action", "content")


@register
def q_gate_scripts(spark, sf):
    return scripts.gate_scripts(_scripts(spark, sf)).select("o_orderkey", "path", "gate")


@register
def q_readiness(spark, sf):
    g = scripts.gate_scripts(_scripts(spark, sf))
    return quality.readiness(g, rejected=F.col("gate") == scripts.REJECT)


@register
def q_rejected_paths(spark, sf):
    """The paths that the gate rejects, a distributed sorted result."""
    g = scripts.gate_scripts(_scripts(spark, sf))
    return quality.rejected_paths(g, rejected=F.col("gate") == scripts.REJECT)


@register
def q_process_managed_scripts(spark, sf):
    """Script processing with a reject row for each unmanaged path."""
    s = _scripts(spark, sf)
    return scripts.process_scripts(s, file_name="file_name", managed=True).select("o_orderkey", "path", "action")


@register
def q_substitute(spark, sf):
    """Replace the component bookmark in each script."""
    s = _scripts(spark, sf)
    return s.select("o_orderkey", text.substitute(F.col("content"), "${plugin}", "x:").alias("content"))


@register
def q_add_tag(spark, sf):
    s = _scripts(spark, sf)
    return s.select("o_orderkey", text.add_tag("content", "component", "file_name").alias("content"),
                    text.fix_comments("content").alias("fixed"))


DOC_KEYWORDS = ("the", "und", "les", "que", "der", "est")


@register
def q_has_sql_orders(spark, sf):
    """Whole-word keyword search over whole documents: default and a caller's list."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.has_sql_orders("text").alias("has_sql_orders"),
                    text.has_sql_orders("text", DOC_KEYWORDS).alias("has_keywords"))


@register
def q_map_lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.map_lines("text", lambda line: F.concat(F.lit("> "), line)).alias("quoted"))


LINE_RULES = (
    dict(vendor="mysql", rule_order=1, pattern=" {2,}", replacement=" "),
    dict(vendor="oracle", rule_order=1, pattern="[ \t]+$", replacement=""),
    dict(vendor="oracle", rule_order=2, pattern="e", replacement="E"),
)


def _vendor():
    return F.expr("CASE lang WHEN 'en' THEN 'mysql' WHEN 'fr' THEN 'oracle' END").alias("vendor")


@register
def q_rewrite_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("content"), _vendor())
    return scripts.rewrite_lines(d, LINE_RULES, vendor="vendor").select("doc_id", "lang", "content")


@register
def q_last_line(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.last_line("text").alias("last_line"), text.line_count("text").alias("n_lines"))


# ------------------------------------------------------------- descriptors
@register
def q_scan_descriptors(spark, sf):
    """Descriptors written as files (some in a sub-folder or with an upper-case
    extension, which the scan leaves out), scanned and parsed."""
    d = fixture(spark, sf, "descriptors")
    name = F.substring_index("path", "/", -1)
    place = (F.when(F.col("p_partkey") % 23 == 0, F.concat(F.lit("more/"), name))
             .when(F.col("p_partkey") % 29 == 0, F.upper(name)).otherwise(name))

    def job(root):
        p = descriptors.parse_descriptors(files.scan_descriptors(spark, root), which="last")
        return p.select("path", "valid", "name_first", F.col("name").alias("name_last"), "version", "db_required")

    return _over_tree(spark, d.select(place.alias("path"), F.col("xml").alias("content")), "scan-descriptors", job)


@register
def q_parse_descriptors(spark, sf):
    d = fixture(spark, sf, "descriptors")
    p = descriptors.parse_descriptors(d, which="last")
    return p.select("p_partkey", "path", "valid", "name_first", F.col("name").alias("name_last"), "version", "db_required")


@register
def q_plugin_state(spark, sf):
    return descriptors.plugin_state(fixture(spark, sf, "descriptors"))


@register
def q_descriptor_rejects(spark, sf):
    return descriptors.descriptor_rejects(fixture(spark, sf, "descriptors"), keep=("p_partkey",))


@register
def q_state_lines(spark, sf):
    """Labels as plugin flags: quality=1 installs doc-<id>, toxic=1 adds a pool line."""
    lb = table(spark, sf, "labels").where(descriptors.flag_is_one(F.col("quality").cast("string")))
    return lb.select("doc_id", F.explode(descriptors.state_lines(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")),
        descriptors.flag_is_one(F.col("toxic").cast("string")))).alias("kv")).select("doc_id", "kv.key", "kv.value")


# ------------------------------------------------------------------ naming
@register
def q_naming(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.lit("app-"), "event_type").alias("base"),
        F.expr("CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'webapp' END").alias("classifier"),
        F.expr("'1.' || CAST(user_id % 7 AS STRING) || CASE WHEN event_id % 2 = 0 THEN '-SNAPSHOT' ELSE '' END")
        .alias("version"))
    return ev.select("event_id",
                     vfn.archive_name("base", "classifier", "version", "ts", "zip").alias("archive_name"),
                     vfn.stamp_name(F.concat_ws("-", "base", "version"), "version", "ts").alias("stamp_name"),
                     vfn.release_version("version").alias("release_version"),
                     vfn.is_snapshot("version").alias("is_snapshot"))


@register
def q_version_from(spark, sf):
    s = _scripts(spark, sf)
    return s.select("o_orderkey", "path", vfn.version_from("path").alias("version_from"),
                    vfn.version_from("path", use_path=True).alias("version_from_path"))


# ----------------------------------------------------------------- closure
@register
def q_dependency_closure(spark, sf):
    edges = fixture(spark, sf, "edges_half").unionByName(fixture(spark, sf, "edges_jump"))
    c = closure.dependency_closure(fixture(spark, sf, "roots"), edges)
    return c.select("node")


# ---------------------------------------------------------------- assemble
def _assembly_layers(spark, sf):
    files = fixture(spark, sf, "paths").select("layer", "priority", "path", "mtime", "doc_id", "content")
    conf = fixture(spark, sf, "scripts").select(
        F.lit("conf").alias("layer"), F.lit(4).alias("priority"),
        F.concat(F.lit("WEB-INF/sql/"), "file_name").alias("path"),
        (F.lit(1700000000000) + F.col("o_orderkey") * 1000).alias("mtime"), "o_orderkey", "content")
    return files, conf


@register
def q_assemble(spark, sf):
    """core < plugins (newer-wins on mtime) < site < conf scripts; then the script gate."""
    files, conf = _assembly_layers(spark, sf)
    out = assemble_op.assemble([files, conf], tiebreak=["mtime", "doc_id", "o_orderkey"], newer=[2])
    return out.select("path", "layer", "priority", "doc_id", "o_orderkey", "gate")


@register
def q_assemble_late(spark, sf):
    """The same tree with contents read for winners only."""
    files, conf = _assembly_layers(spark, sf)
    out = assemble_op.assemble_late([files, conf], tiebreak=["mtime", "doc_id", "o_orderkey"], newer=[2])
    return out.select("path", "layer", "priority", "doc_id", "o_orderkey", "gate", F.md5("content").alias("content_md5"))


@register
def q_assemble_readiness(spark, sf):
    files, conf = _assembly_layers(spark, sf)
    out = assemble_op.assemble([files, conf], tiebreak=["mtime", "doc_id", "o_orderkey"], newer=[2])
    return assemble_op.assemble_readiness(out)


# --------------------------------------------------------------- streaming
@register
def q_sync_stream(spark, sf):
    """The source window of events as a file stream merged into the target
    snapshot by foreachBatch; the final state equals incremental_sync."""
    from strata.streaming import sync_stream as ss
    schema = table(spark, sf, "events").schema
    # the pattern matches one name: a file, or a folder of part files, is read whole
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/event[s].parquet")
    src = stream.where(F.expr(FIXTURES["events_source"].where)).select("user_id", "event_type", "event_id",
                                                                       "ts", "value")
    tgt = fixture(spark, sf, "events_target")
    state_dir, ckpt = scratch_path(spark, "sync-stream-state"), scratch_path(spark, "sync-stream-ckpt")
    ss.seed_state(tgt, state_dir, EVENT_KEY, "ts", buckets=64)
    q = ss.sync_stream(src, state_dir, ckpt, EVENT_KEY, "ts", buckets=64)
    q.awaitTermination()
    return ss.read_state(spark, state_dir).select("user_id", "event_type", "event_id", "ts", "value")


@register
def q_sync_into(spark, sf):
    """The target snapshot seeded as a bucketed state table, then the source
    merged in place: only touched buckets are read and rewritten."""
    state = scratch_path(spark, "sync-into-state")
    sync.sync_into(fixture(spark, sf, "events_target"), state, EVENT_KEY, "ts", buckets=64)
    sync.sync_into(fixture(spark, sf, "events_source"), state, EVENT_KEY, "ts", buckets=64)
    return spark.read.parquet(state).select("user_id", "event_type", "event_id", "ts", "value")


@register
def q_deploy_scripts(spark, sf):
    """Deployable scripts: core scripts unrouted, plugin-o for mysql, others 'auto' (configured oracle)."""
    s = _scripts(spark, sf).withColumn(
        "vendor", F.expr("CASE component WHEN 'core' THEN 'none' WHEN 'plugin-o' THEN 'mysql' ELSE 'auto' END"))
    out = scripts.deploy_scripts(s, LINE_RULES, requested="vendor", configured=F.lit("oracle"))
    return out.select("o_orderkey", "path", "target_vendor", "content")


@register
def q_rewrite_lines_table(spark, sf):
    """The line rules as rows."""
    rules = spark.createDataFrame([(r["vendor"], r["rule_order"], r["pattern"], r["replacement"]) for r in LINE_RULES],
                                  "vendor string, rule_order int, pattern string, replacement string")
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("content"), _vendor())
    return scripts.rewrite_lines_by_table(d, rules, "vendor").drop("vendor")


# ----------------------------------------------------------- sources, sinks
@register
def q_last_line_long(spark, sf):
    """Documents written as files and read line by line: last line and number of lines."""
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return _over_tree(spark, d, "last-line-long", lambda root: files.last_lines(files.scan_lines(spark, root)))


@register
def q_scan_reported(spark, sf):
    """Documents written as files and scanned with a status each; those beyond 2,000 bytes count as too large."""
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))

    def job(root):
        found = files.scan_files_reported(spark, root, ext=".txt", max_size=2000)
        return found.select("path", "length", "status", "reason", F.md5("content").alias("content_md5"))

    return _over_tree(spark, d, "scan-reported", job)


@register
def q_scan_files(spark, sf):
    """Documents written as text files by source, scanned back: bytes per folder."""
    root = scratch_path(spark, "scan-files")
    table(spark, sf, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(root)
    found = files.scan_files(spark, root, ext=".TXT")
    return (found.groupBy(F.regexp_extract("path", "^source=([^/]*)/", 1).alias("source"))
            .agg(F.sum("length").alias("n_bytes")))


@register
def q_scan_scripts(spark, sf):
    """Whole scripts, written as files and scanned back (empty ones are not listed)."""
    return _over_tree(spark, _scripts(spark, sf), "scan-scripts", lambda root: files.scan_scripts(spark, root).select("path", "content"))


@register
def q_write_back(spark, sf):
    """A tree of scripts after a run: scanned, processed, written back over itself, scanned again."""
    component, name = F.split("path", "/")[3], F.substring_index("path", "/", -1)
    back = scratch_path(spark, "write-back-spare")

    def job(root):
        found = files.scan_scripts(spark, root).withColumns({"component": component, "file_name": name})
        sinks.write_back(scripts.process_scripts(found, file_name="file_name"), root, spare=back)
        return files.scan_scripts(spark, root).select("path", "content")

    return _over_tree(spark, _scripts(spark, sf), "write-back", job, back)


@register
def q_write_scripts(spark, sf):
    out = sinks.write_scripts(scripts.process_scripts(_scripts(spark, sf), file_name="file_name"), scratch_path(spark, "write-scripts"))
    return spark.read.parquet(out).select("path", "action", "content")


@register
def q_write_state(spark, sf):
    """The plugin state lines of the labels, written and read back."""
    out = sinks.write_state(q_state_lines(spark, sf), scratch_path(spark, "write-state"))
    line = F.split("value", "=", 2)
    return spark.read.text(out).select(line[0].alias("key"), line[1].alias("value"))


@register
def q_write_manifest(spark, sf):
    out = sinks.write_manifest(q_package_membership(spark, sf), scratch_path(spark, "write-manifest"))
    return spark.read.parquet(out).select("package", "entry_path", "source_path")


# ---------------------------------------------------------- script versions
@register
def q_target_version(spark, sf):
    """The version each script leads to."""
    s = _scripts(spark, sf)
    return s.select("o_orderkey", "path", vfn.target_version("path").alias("target_version"))


@register
def q_script_drift(spark, sf):
    """Components whose newest script leads beyond what they declare (core: 2.0.0,
    others: 1.5.0)."""
    s = _scripts(spark, sf).withColumn("version", vfn.target_version("path"))
    declared = s.select("component").distinct().withColumn(
        "declared_version", F.when(F.col("component") == "core", "2.0.0").otherwise("1.5.0"))
    return versions.version_drift(s, declared, ["component"])


@register
def q_one_per_component(spark, sf):
    """Per manufacturer the descriptor of the lowest path; the others are extras."""
    d = fixture(spark, sf, "descriptors").select("p_partkey", "path")
    d = d.join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return descriptors.one_per_component(d, "p_brand").select("p_partkey", "p_brand", "extra")


# ------------------------------------------------------------- layer chain
def _chain_trees(spark, sf):
    """Every document as a file of one of the eleven layers."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "source", (F.col("n_chars") % 50).cast("string")).alias("path"),
        (F.lit(1700000000000) + (F.col("doc_id") * 7919) % 1000003 * 1000).alias("mtime"))
    return {name: d.where(F.col("doc_id") % 11 == i) for i, (name, _) in enumerate(assemble_op.CHAIN)}


@register
def q_assemble_chain(spark, sf):
    """The eleven layers of a first run."""
    out = assemble_op.assemble_chain(_chain_trees(spark, sf), tiebreak=["mtime", "doc_id"], place=False)
    return out.select("path", "doc_id", "layer")


@register
def q_assemble_chain_update(spark, sf):
    """A later run: the first three layers are the target as it stands."""
    trees = _chain_trees(spark, sf)
    target = overlay.union_layers(*(trees.pop(n) for n in assemble_op.LATER_RUN_SKIPS))
    out = assemble_op.assemble_chain(trees, target, tiebreak=["mtime", "doc_id"], place=False)
    return out.select("path", "doc_id", "layer")
