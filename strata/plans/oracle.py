"""Independent DuckDB SQL for each registered query.

Written from the operator contracts, not generated from the Spark code:
windows and joins where Spark uses keyed aggregates, hand-written regexes
where Spark uses the glob translator. Inputs come from the shared fixture
projections (``fixture_sql``), so both sides read the same derived rows.
"""

from __future__ import annotations

from strata.plans.fixtures import fixture_sql as fx

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


# ----------------------------------------------------------------- overlay
sql("layered_overlay", f"""
SELECT l_orderkey, l_linenumber, layer, priority, l_shipdate, l_suppkey, l_partkey, l_extendedprice, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY priority DESC, l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC) AS rn
      FROM {fx('layers')}) WHERE rn = 1
""")

_DECISIONS = f"""(SELECT l_orderkey, l_linenumber, layer, priority, l_shipdate, l_suppkey, l_partkey,
     l_extendedprice, l_quantity,
     row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY priority DESC, l_shipdate DESC,
       l_suppkey DESC, l_partkey DESC, l_extendedprice DESC) = 1 AS won FROM {fx('layers')})"""
sql("overlay_decisions", f"SELECT * FROM {_DECISIONS}")
sql("layer_counters", f"""
SELECT layer, CASE WHEN won THEN 'KEPT' ELSE 'OVERRIDDEN' END AS action, count(*) AS n FROM {_DECISIONS}
GROUP BY 1, 2
""")

_LAYER_ORDER = "l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC"
sql("overlay_newer", f"""
WITH L AS {fx('layers')},
seg AS (
  SELECT *, CASE priority WHEN 2 THEN 'n' WHEN 1 THEN 'a' ELSE 'r' END AS seg,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber, priority ORDER BY {_LAYER_ORDER}) AS rn
  FROM L),
w AS (SELECT * FROM seg WHERE rn = 1),
pick AS (
  SELECT k.l_orderkey, k.l_linenumber,
         CASE WHEN r.l_orderkey IS NOT NULL THEN 'r'
              WHEN n.l_orderkey IS NOT NULL AND (a.l_orderkey IS NULL OR n.l_shipdate > a.l_shipdate) THEN 'n'
              ELSE 'a' END AS seg
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM L) k
  LEFT JOIN w a ON a.seg = 'a' AND a.l_orderkey = k.l_orderkey AND a.l_linenumber = k.l_linenumber
  LEFT JOIN w n ON n.seg = 'n' AND n.l_orderkey = k.l_orderkey AND n.l_linenumber = k.l_linenumber
  LEFT JOIN w r ON r.seg = 'r' AND r.l_orderkey = k.l_orderkey AND r.l_linenumber = k.l_linenumber)
SELECT w.l_orderkey, w.l_linenumber, layer, priority, l_shipdate, l_suppkey, l_partkey, l_extendedprice, l_quantity
FROM w JOIN pick USING (l_orderkey, l_linenumber, seg)
""")

sql("dedupe_first", """
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
        l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1
""")

sql("union_layers", f"""
SELECT 'documents' AS layer, path, length, NULL::VARCHAR AS component FROM {fx('paths')}
UNION ALL SELECT 'scripts', 'src/sql/' || file_name, NULL, component FROM {fx('scripts')}
UNION ALL SELECT 'descriptors', path, NULL, NULL FROM {fx('descriptors')}
""")

sql("flatten_to", f"""
SELECT path, mtime, doc_id, source_path FROM (
  SELECT 'WEB-INF/lib/' || regexp_extract(path, '([^/]*)$', 1) AS path, mtime, doc_id, path AS source_path,
         row_number() OVER (PARTITION BY regexp_extract(path, '([^/]*)$', 1)
                            ORDER BY mtime DESC, path DESC, doc_id DESC) AS rn
  FROM {fx('paths')}) WHERE rn = 1
""")

_EVENTS_LATEST = """(SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts,
   arg_max(value, ts) AS value FROM {src} GROUP BY user_id, event_type)"""
_SYNC_JOIN = f"""
WITH t AS {_EVENTS_LATEST.format(src=fx('events_target'))},
     s AS {_EVENTS_LATEST.format(src=fx('events_source'))},
j AS (SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.event_type, s.event_type) AS event_type,
             t.user_id IS NOT NULL AS has_t, s.user_id IS NOT NULL AS has_s,
             s.user_id IS NOT NULL AND (t.user_id IS NULL OR s.ts > t.ts) AS copy,
             s.event_id AS s_id, s.ts AS s_ts, s.value AS s_value, t.event_id AS t_id, t.ts AS t_ts, t.value AS t_value
      FROM t FULL OUTER JOIN s ON t.user_id = s.user_id AND t.event_type = s.event_type)"""
_SYNC_PLAN = f"""{_SYNC_JOIN},
plan AS (SELECT user_id, event_type,
           CASE WHEN NOT has_t THEN 'NEW' WHEN NOT has_s THEN 'TARGET_ONLY' WHEN copy THEN 'UPDATED'
                ELSE 'UNCHANGED' END AS action, s_ts AS source_ts, t_ts AS target_ts FROM j)"""

sql("incremental_sync", f"""{_SYNC_JOIN}
SELECT user_id, event_type, CASE WHEN copy THEN s_id ELSE t_id END AS event_id,
       CASE WHEN copy THEN s_ts ELSE t_ts END AS ts, CASE WHEN copy THEN s_value ELSE t_value END AS value
FROM j
""")

sql("sync_plan", f"""{_SYNC_PLAN}
SELECT * FROM plan
""")

sql("verify_copy", f"""{_SYNC_JOIN}
SELECT user_id, event_type,
       CASE WHEN NOT has_t THEN 'MISSING_IN_TARGET' WHEN NOT has_s THEN 'MISSING_IN_SOURCE'
            ELSE 'LENGTH_DIFFERS' END AS status, s_id AS source_length, t_id AS target_length
FROM j WHERE NOT has_t OR NOT has_s OR s_id IS DISTINCT FROM t_id
""")

sql("run_counters", f"""{_SYNC_PLAN}
SELECT event_type, action, count(*) AS n FROM plan GROUP BY event_type, action
""")


sql("written_counters", f"""{_SYNC_PLAN}
SELECT a AS action, count(action) AS n FROM (VALUES ('NEW'), ('UPDATED'), ('UNCHANGED'), ('TARGET_ONLY')) v(a) LEFT JOIN plan ON action = a GROUP BY a
""")


# ---------------------------------------------------------------- versions
def _vkey(v: str) -> str:
    """DuckDB version key columns: nums (list), rnk, qn, qt."""
    lead = f"regexp_extract({v}, '^[0-9]+(\\.[0-9]+)*')"
    qual = f"lower(regexp_replace(substr({v}, length({lead}) + 1), '^[._-]+', ''))"
    word = f"regexp_extract({qual}, '^([a-z]*)', 1)"
    rank = (f"CASE WHEN {word} IN ('alpha', 'a') THEN 1 WHEN {word} IN ('beta', 'b') THEN 2"
            f" WHEN {word} IN ('milestone', 'm') THEN 3 WHEN {word} IN ('rc', 'cr') THEN 4"
            f" WHEN {word} = 'snapshot' THEN 5 WHEN {word} IN ('', 'ga', 'final', 'release') THEN 6"
            f" WHEN {word} = 'sp' THEN 7 ELSE 8 END")
    return (f"list_transform(string_split(regexp_replace({lead}, '(\\.0+)+$', ''), '.'),"
            f" lambda x: TRY_CAST(x AS HUGEINT)) AS nums, {rank} AS rnk,"
            f" coalesce(TRY_CAST(regexp_extract({qual}, '([0-9]+)$', 1) AS HUGEINT), 0) AS qn,"
            f" CASE WHEN {rank} = 8 THEN {qual} ELSE '' END AS qt")


def _gt(a: str, b: str) -> str:
    return (f"({a}.nums > {b}.nums OR ({a}.nums = {b}.nums AND ({a}.rnk > {b}.rnk"
            f" OR ({a}.rnk = {b}.rnk AND ({a}.qn > {b}.qn OR ({a}.qn = {b}.qn AND {a}.qt > {b}.qt))))))")


_PV = f"(SELECT *, {_vkey('version')} FROM {fx('part_versions')})"
_NEWEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}
   ORDER BY nums DESC, rnk DESC, qn DESC, qt DESC, version DESC) AS rn FROM pv WHERE {where}) WHERE rn = 1)"""
_CAND_WHERE = "((brand_no <= 15 AND artifact_id NOT LIKE 'cold%') OR (brand_no > 15 AND group_id = 'LARGE'))"
_CUR_WHERE = "((brand_no >= 10 AND group_id <> 'LARGE') OR (brand_no <= 15 AND artifact_id LIKE 'cold%'))"
_RECONCILE = f"""
WITH pv AS {_PV},
c AS {_NEWEST.format(key='group_id, artifact_id', where=_CAND_WHERE)},
u AS {_NEWEST.format(key='group_id, artifact_id', where=_CUR_WHERE)},
j AS (SELECT c.group_id, c.artifact_id, c.version, u.version AS cur_version, u.group_id IS NOT NULL AS has_u,
             u.group_id IS NULL OR {_gt('c', 'u')} AS newer
      FROM c LEFT JOIN u ON c.group_id = u.group_id AND c.artifact_id = u.artifact_id),
plan AS (
  SELECT group_id, artifact_id, 'COPY' AS action, version FROM j WHERE newer
  UNION ALL SELECT group_id, artifact_id, 'DELETE', cur_version FROM j WHERE has_u AND newer
  UNION ALL SELECT group_id, artifact_id, 'SKIP', version FROM j WHERE NOT newer),
cur AS (SELECT DISTINCT group_id, artifact_id, version FROM pv WHERE {_CUR_WHERE}),
cand AS (SELECT DISTINCT group_id, artifact_id, version FROM pv WHERE {_CAND_WHERE})"""

sql("version_reconcile", f"""{_RECONCILE}
SELECT * FROM plan
""")

sql("apply_plan", f"""{_RECONCILE}
SELECT DISTINCT * FROM (
  SELECT * FROM cur s WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.action = 'DELETE'
      AND p.group_id = s.group_id AND p.artifact_id = s.artifact_id AND p.version = s.version)
  UNION ALL SELECT group_id, artifact_id, version FROM plan WHERE action = 'COPY')
""")

sql("accumulate", f"""{_RECONCILE}
SELECT * FROM cur UNION SELECT * FROM cand
""")

sql("max_version", f"""
WITH pv AS {_PV}
SELECT group_id, version AS max_version FROM {_NEWEST.format(key='group_id', where="artifact_id NOT LIKE 'cold%'")}
""")

sql("version_drift", f"""
WITH pv AS {_PV},
c AS {_NEWEST.format(key='group_id', where=_CAND_WHERE)},
u AS {_NEWEST.format(key='group_id', where=_CUR_WHERE)}
SELECT c.group_id, u.version AS declared_version, c.version AS newest_version
FROM c JOIN u ON c.group_id = u.group_id WHERE {_gt('c', 'u')}
""")

sql("version_key", f"""
SELECT p_partkey, version, array_to_string(nums, '.') AS key_numbers, rnk AS key_rank, CAST(qn AS BIGINT) AS key_qualifier_number, qt AS key_text,
       CASE WHEN suffix(version, '-SNAPSHOT') THEN split_part(version, '-SNAPSHOT', 1) ELSE version END
         AS release_version,
       suffix(upper(version), 'SNAPSHOT') OR regexp_full_match(version, '(.*)-([0-9]{{8}}\\.[0-9]{{6}})-([0-9]+)')
         AS is_snapshot
FROM {_PV}
""")

sql("remove_named", f"""{_RECONCILE}
SELECT DISTINCT 'WEB-INF/lib/' || artifact_id || '-' || version || '.jar' AS path FROM cur
EXCEPT
SELECT 'WEB-INF/lib/' || artifact_id || '-' || version || '.jar' FROM plan WHERE action = 'DELETE'
""")


# ---------------------------------------------------------------- patterns
# Hand-written full-match regexes (RE2), one per glob used by the queries.
G = {
    "**/**": r".*",
    "**/user/**": r"(.*/)?user(/.*)?",
    "**/resources/**": r"(.*/)?resources(/.*)?",
    "**/WEB-INF/classes/**": r"(.*/)?WEB-INF/classes(/.*)?",
    "WEB-INF/lib/**": r"WEB-INF/lib(/.*)?",
    "**/.svn/**": r"(.*/)?\.svn(/.*)?",
    "**/target/**": r"(.*/)?target(/.*)?",
    "**/src/**": r"(.*/)?src(/.*)?",
    "**/webapp/**": r"(.*/)?webapp(/.*)?",
    "**/.settings/**": r"(.*/)?\.settings(/.*)?",
    "*.*": r"[^/]*\.[^/]*",
    "**/package.html": r"(.*/)?package\.html",
    "**/fr/paris/lutece/**/resources/**": r"(.*/)?fr/paris/lutece/(.*/)?resources(/.*)?",
    "**/fr/paris/lutece/**/business/**": r"(.*/)?fr/paris/lutece/(.*/)?business(/.*)?",
    "**/fr/paris/lutece/**/web/**": r"(.*/)?fr/paris/lutece/(.*/)?web(/.*)?",
    "**/fr/paris/lutece/**/service/**": r"(.*/)?fr/paris/lutece/(.*/)?service(/.*)?",
    "**/fr/paris/lutece/**/utils/**": r"(.*/)?fr/paris/lutece/(.*/)?utils(/.*)?",
    "**/fr/paris/lutece/**/util/**": r"(.*/)?fr/paris/lutece/(.*/)?util(/.*)?",
    "**/WEB-INF/test/**": r"(.*/)?WEB-INF/test(/.*)?",
    "**/create*.sql": r"(.*/)?create[^/]*\.sql",
    "**/init*.sql": r"(.*/)?init[^/]*\.sql",
    "**/*.xml": r"(.*/)?[^/]*\.xml",
    "**/plugin_1*.xml": r"(.*/)?plugin_1[^/]*\.xml",
    "webapp/**": r"webapp(/.*)?",
    "WEB-INF/lib/*.xml": r"WEB-INF/lib/[^/]*\.xml",
    "WEB-INF/lib/*.html": r"WEB-INF/lib/[^/]*\.html",
    "**/*.sql": r"(.*/)?[^/]*\.sql",
    "**/*.SQL": r"(.*/)?[^/]*\.SQL",
    "**/update*2.0.0.sql": r"(.*/)?update[^/]*2\.0\.0\.sql",
    "**/update*9.9.9.sql": r"(.*/)?update[^/]*9\.9\.9\.sql",
}


def _any(globs, col="path") -> str:
    return "(" + " OR ".join(f"regexp_full_match({col}, '{G[g]}')" for g in globs) + ")" if globs else "FALSE"


def _sel(inc, exc, col="path") -> str:
    return f"({_any(inc, col)} AND NOT {_any(exc, col)})"


# The header text, keywords and profiles must equal the operators'.
_PROFILES_SQL = {  # the profiles again, as lists of the globs above
    "package_classes": (["**/**"], ["**/package.html", "**/fr/paris/lutece/**/resources/**"]),
    "package_webapp": (["**/**"], ["**/WEB-INF/classes/**", "WEB-INF/lib/**", "**/.svn/**"]),
    "package_site": (["**/user/**"], ["**/.svn/**"]),
    "package_resources": (["**/resources/**"], [
        "**/fr/paris/lutece/**/business/**", "**/fr/paris/lutece/**/web/**", "**/fr/paris/lutece/**/service/**",
        "**/fr/paris/lutece/**/utils/**", "**/fr/paris/lutece/**/util/**", "**/WEB-INF/test/**",
        "**/package.html", "**/.svn/**"]),
    "assembly_webapp": (["**/**"], ["**/WEB-INF/classes/**", "WEB-INF/lib/**", "**/.svn/**"]),
    "assembly_site": (["**/user/**"], ["**/.svn/**"]),
    "updater": (["**/**"], ["**/WEB-INF/classes/**", "WEB-INF/lib/**", "**/.svn/**", "**/target/**",
                            "**/src/**", "**/.settings/**", "*.*"]),
    "release": (["**/create*.sql", "**/init*.sql"], ["**/.svn/**"]),
    "source_src": (["**/src/**"], ["**/.svn/**", "**/target/**", "**/webapp/**"]),
    "source_webapp": (["**/webapp/**"], ["**/.svn/**", "**/WEB-INF/classes/**"]),
}
_PROFILES_SQL["assembly_site_tree"] = (["**/**"], _PROFILES_SQL["package_resources"][1])
_P = f"(SELECT doc_id, path, layer FROM {fx('paths')})"

sql("glob_filter", f"SELECT doc_id, path, layer FROM {_P} WHERE {_sel(*_PROFILES_SQL['package_webapp'])}")

sql("pattern_profile", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS profile, doc_id, path FROM {_P} WHERE {_sel(inc, exc)}"
    for name, (inc, exc) in _PROFILES_SQL.items()))

sql("path_exclude", rf"""
SELECT doc_id, path FROM {_P}
WHERE NOT regexp_full_match(path, '(.)*site/site(.)*.xml') AND NOT regexp_full_match(path, '(.)*/tech(/.)*')
  AND NOT regexp_full_match(path, '(.)*/xdoc/[^/]*\.(.)*')
  AND NOT regexp_full_match(path, '(.)*/resources/images/[^/]*\.(.)*')
  AND NOT regexp_matches(path, '(^|/)\.svn/') AND NOT regexp_matches(path, '(^|/)tech/')
""")

sql("remap_prefix", f"""
SELECT doc_id, CASE WHEN starts_with(path, 'src/sql/') THEN 'WEB-INF/sql/' || substr(path, 9) ELSE path END AS path
FROM {_P}
""")

sql("relative_path", f"""
SELECT doc_id, CASE WHEN starts_with(path, 'webapp/') THEN substr(path, 8) ELSE path END AS path FROM {_P}
""")

sql("normalize_path", f"""
WITH w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(92) || 'C:' || chr(92) ELSE '' END
                  || replace(path, '/', chr(92)) || CASE WHEN doc_id % 2 = 0 THEN chr(92) ELSE '' END AS raw_path
           FROM {_P}),
a AS (SELECT doc_id, raw_path, replace(CASE WHEN length(raw_path) > 3 AND strpos(raw_path, ':') = 3
                 THEN substr(raw_path, 2) ELSE raw_path END, chr(92), '/') AS p FROM w)
SELECT doc_id, raw_path, CASE WHEN suffix(p, '/') THEN substr(p, 1, length(p) - 1) ELSE p END AS path FROM a
""")

sql("has_extension", f"""
SELECT doc_id, path, suffix(lower(path), '.sql') AS is_sql, suffix(path, '.sql') AS is_sql_exact,
       suffix(lower(path), '.xml') AS is_xml FROM {_P}
""")

sql("extract_subtree", f"""
WITH sub AS (SELECT doc_id, 'WEB-INF/' || substr(path, 16) AS path FROM {_P}
             WHERE starts_with(path, 'webapp/WEB-INF/'))
SELECT doc_id, path FROM {_P} e WHERE starts_with(path, 'WEB-INF/')
  AND NOT EXISTS (SELECT 1 FROM sub WHERE sub.path = e.path)
UNION ALL SELECT doc_id, path FROM sub
""")

sql("purge", f"""
SELECT doc_id, path FROM {_P}
WHERE NOT (path = 'target' OR starts_with(path, 'target/') OR path = 'src/java' OR starts_with(path, 'src/java/'))
  AND NOT {_sel(['**/*.xml'], ['**/plugin_1*.xml'])}
""")

sql("purge_roots_table", f"""
WITH r AS (SELECT DISTINCT source || '/fr' AS root FROM documents WHERE lang = 'fr')
SELECT doc_id, path FROM {_P} p
WHERE NOT EXISTS (SELECT 1 FROM r WHERE p.path = r.root OR starts_with(p.path, r.root || '/'))
""")

_RULES_SQL = [  # (package, layer, include, exclude, prefix, order)
    ("webapp", None, ["webapp/**"], ["**/WEB-INF/classes/**"], "", 1),
    ("webapp", None, ["WEB-INF/lib/*.xml", "WEB-INF/lib/*.html"], [], "webapp/", 2),
    ("sql", None, ["**/*.sql", "**/*.SQL"], ["**/.svn/**"], "sql/", 3),
    ("site", "site", ["**/user/**"], [], "", 4),
    ("sources", None, *_PROFILES_SQL["source_src"], "src-archive/", 5),
    ("resources", None, *_PROFILES_SQL["package_resources"], "", 6),
]
_MEMBERS = "\nUNION ALL\n".join(
    f"SELECT '{pk}' AS package, '{pre}' || path AS entry_path, {o} AS rule_order, path AS source_path, doc_id, layer"
    f" FROM {_P} WHERE {_sel(inc, exc)}" + (f" AND layer = '{ly}'" if ly else "")
    for pk, ly, inc, exc, pre, o in _RULES_SQL)
sql("package_membership", f"""
SELECT package, entry_path, rule_order, source_path, doc_id, layer FROM (
  SELECT *, row_number() OVER (PARTITION BY package, entry_path
                               ORDER BY rule_order DESC, source_path DESC, doc_id DESC) AS rn
  FROM ({_MEMBERS})) WHERE rn = 1
""")

_RULED = "regexp_matches(path, '^src[0-9]+/[a-z]+/') AND NOT regexp_matches(path, '(^|/)create[^/]*$')"
sql("package_membership_table", f"""
SELECT * FROM ({ORACLE['package_membership']})
UNION ALL
SELECT 'by-' || split_part(path, '/', 1) || '-' || split_part(path, '/', 2), path, 9, path, doc_id, layer FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id DESC) AS rn FROM {_P}
  WHERE {_RULED} AND (split_part(path, '/', 1), split_part(path, '/', 2)) IN (SELECT (source, lang) FROM documents)) WHERE rn = 1
""")

sql("release_packages", f"""
SELECT 'release-2.0.0' AS package, path AS entry_path, path AS source_path FROM {_P}
WHERE {_sel(['**/create*.sql', '**/init*.sql'], ['**/.svn/**'])}
""")

_SF = f"(SELECT 'src/sql/plugins/' || component || '/' || file_name AS path FROM {fx('scripts')})"
_VFROM = ("CASE WHEN regexp_full_match(regexp_extract(path, '([^/]*)$', 1), '[^-]*-.*-[^-]*')"
          " THEN regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^[^-]*-(.*)-[^-]*$', 1) END")


def _upgrade(version: str) -> str:
    g = f"**/update*{version}.sql"
    return f"""
WITH m AS (SELECT path, {_VFROM} AS vfrom FROM {_SF} WHERE {_any([g])})
SELECT 'upgrade-' || vfrom || '-{version}' AS package, path AS entry_path, path AS source_path
FROM m WHERE vfrom IS NOT NULL
UNION ALL
SELECT 'upgrade-1.0.0-{version}', NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM m)
"""


sql("upgrade_packages", _upgrade("2.0.0"))
sql("upgrade_default", _upgrade("9.9.9"))
sql("upgrade_rejects", f"""
SELECT path, 'no from-version' AS reason FROM (SELECT path, {_VFROM} AS vfrom FROM {_SF} WHERE {_any(['**/update*2.0.0.sql'])}) WHERE vfrom IS NULL
""")
sql("or_default", f"""
WITH m AS (SELECT path FROM {_SF} WHERE suffix(path, '-9.9.9.sql'))
SELECT path FROM m UNION ALL SELECT 'none' WHERE NOT EXISTS (SELECT 1 FROM m)
""")


# --------------------------------------------------------------- artifacts
_A = f"(SELECT l_orderkey, l_linenumber, group_id, artifact_id, version, type, scope FROM {fx('artifacts')})"


def _is(col: str, *vals: str) -> str:
    return f"coalesce({col} IN ({', '.join(repr(v) for v in vals)}), false)"


sql("by_type", f"SELECT * FROM {_A} WHERE {_is('type', 'lutece-plugin')}")
sql("third_party", f"SELECT * FROM {_A} WHERE {_is('type', 'jar')} AND {_is('scope', 'runtime', 'compile')}")
sql("direct_dependency", f"""SELECT * FROM {_A}
WHERE NOT {_is('type', 'lutece-core', 'lutece-plugin')} AND NOT {_is('scope', 'provided', 'test')}""")
sql("transitive_dependency", f"""SELECT * FROM {_A}
WHERE NOT {_is('scope', 'provided', 'test')} AND NOT {_is('artifact_id', 'junit', 'servlet-api')}""")
sql("multi_module_filter", f"""SELECT * FROM {_A}
WHERE NOT {_is('artifact_id', 'lutece-core', 'servlet-api')} AND NOT {_is('scope', 'provided', 'test')}""")
sql("artifact_filter", f"SELECT * FROM {_A} WHERE group_id = 'g1' AND starts_with(version, '3.')")

sql("vendor_route", """
WITH e AS (SELECT event_id,
             CASE event_type WHEN 'view' THEN 'mysql' WHEN 'click' THEN 'postgresql' WHEN 'purchase' THEN 'auto'
                             WHEN 'signup' THEN 'none' ELSE 'sybase' END AS requested,
             CASE WHEN user_id % 2 = 0 THEN 'oracle' END AS configured FROM events),
s AS (SELECT *,
        CASE WHEN requested IS NULL OR requested = 'none' THEN 'PASS'
             WHEN requested = 'auto' AND configured IS NULL THEN 'ERROR'
             WHEN requested = 'auto' OR requested IN ('hsqldb', 'mysql', 'oracle', 'postgresql') THEN 'ROUTED'
             ELSE 'ERROR' END AS route_status FROM e)
SELECT event_id, requested, configured,
       CASE WHEN requested IS NULL OR requested = 'none' THEN NULL WHEN requested = 'auto' THEN configured
            WHEN requested IN ('hsqldb', 'mysql', 'oracle', 'postgresql') THEN requested END AS target_vendor,
       route_status,
       CASE WHEN route_status = 'ERROR' THEN 'no such database vendor: '''
            || coalesce(CASE WHEN requested = 'auto' THEN configured END, requested, '') || '''' END AS route_error
FROM s
""")

# ----------------------------------------------------------------- quality
sql("cardinality_check", """
SELECT c.c_custkey, coalesce(o.n, 0) AS n, coalesce(o.n, 0) >= 0 AND coalesce(o.n, 0) <= 1 AS ok
FROM (SELECT DISTINCT c_custkey FROM customer) c
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o
  ON c.c_custkey = o.c_custkey
""")

sql("allowed_values", """
SELECT o_orderkey, o_orderpriority, false AS allowed,
       'o_orderpriority ''' || coalesce(o_orderpriority, 'null')
       || ''' is not allowed; allowed values: 1-URGENT, 2-HIGH, 3-MEDIUM' AS message
FROM orders WHERE NOT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'), false)
""")

# ----------------------------------------------------------------- scripts
_WORD = r"[\p{L}\p{Nd}\p{Mn}_]"
_NOTWORD = r"[^\p{L}\p{Nd}\p{Mn}_]"


def _has_words(col: str, words) -> str:
    alt = "|".join(w.lower() for w in words)
    return f"regexp_matches({col}, '(^|{_NOTWORD})({alt})({_NOTWORD}|$)', 'i')"


_SQLKW = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TRUNCATE", "GRANT", "REVOKE")
_COMPACT = "(?m)^--(liquibase formatted sql|changeset|preconditions)"
_S = f"""(SELECT *, path_ AS path FROM (SELECT *, 'src/sql/plugins/' || component || '/' || file_name AS path_
   FROM {fx('scripts')}))"""
_SCLASS = f"""(SELECT *,
   NOT regexp_matches(content, '[^\\x00-\\x20]') AS is_blank,
   {_has_words('content', _SQLKW)} AS has_sql_orders,
   starts_with(content, '-- liquibase formatted sql') OR starts_with(content, '--liquibase formatted sql') AS is_tagged,
   regexp_matches(content, '{_COMPACT}') AS needs_fixing,
   coalesce(regexp_matches(path, '(?i)(^|/)(create|init|update)[^/]*\\.sql$'), false) AS is_managed
 FROM {_S})"""
_ACTION = ("CASE WHEN content IS NULL THEN NULL WHEN is_blank OR NOT has_sql_orders THEN 'IGNORED'"
           " WHEN NOT is_tagged THEN 'TAGGED' WHEN needs_fixing THEN 'FIXED' ELSE 'UNCHANGED' END")
_HEADER = ("'-- liquibase formatted sql' || chr(10) || '-- changeset ' || coalesce(component, 'core') || ':'"
           " || file_name || chr(10) || '-- preconditions onFail:MARK_RAN onError:WARN' || chr(10)")
_GATE = f"""(SELECT *, CASE WHEN regexp_extract(path, '([^/]*)$', 1) = 'build.properties' THEN 'PASS'
   WHEN NOT suffix(lower(path), '.sql') OR coalesce(strlen(content), 1) = 0 THEN 'DROP'
   WHEN NOT is_managed THEN 'DROP' WHEN coalesce(is_tagged, false) THEN 'PASS' ELSE 'REJECT' END AS gate
 FROM {_SCLASS})"""

sql("script_functions", f"""
SELECT o_orderkey, path, is_blank, has_sql_orders, is_tagged, coalesce(is_tagged, false) AS first_line_tagged,
       needs_fixing, is_managed, {_ACTION} AS action FROM {_SCLASS}
""")

sql("process_scripts", f"""
SELECT o_orderkey, path, action,
       CASE action WHEN 'TAGGED' THEN {_HEADER} || content
                   WHEN 'FIXED' THEN regexp_replace(content, '{_COMPACT}', '-- \\1', 'g')
                   ELSE content END AS content
FROM (SELECT *, {_ACTION} AS action FROM {_SCLASS})
""")

sql("gate_scripts", f"SELECT o_orderkey, path, gate FROM {_GATE}")

sql("readiness", f"""
SELECT count(*) = 0 AS ready, count(*) AS n_rejected FROM {_GATE} WHERE gate = 'REJECT'
""")

sql("rejected_paths", f"SELECT path FROM {_GATE} WHERE gate = 'REJECT'")

sql("process_managed_scripts", f"""
SELECT o_orderkey, path, CASE WHEN is_managed THEN {_ACTION} ELSE 'REJECTED' END AS action FROM {_SCLASS}
""")

sql("substitute", f"SELECT o_orderkey, replace(content, 'x:', '${{plugin}}') AS content FROM {_S}")

sql("add_tag", f"""
SELECT o_orderkey, {_HEADER} || content AS content, regexp_replace(content, '{_COMPACT}', '-- \\1', 'g') AS fixed
FROM {_S}
""")

sql("has_sql_orders", f"""
SELECT doc_id, {_has_words('text', _SQLKW)} AS has_sql_orders,
       {_has_words('text', ('the', 'und', 'les', 'que', 'der', 'est'))} AS has_keywords
FROM documents
""")

_LINES = r"string_split_regex(regexp_replace({c}, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r')"


def _map_lines(c: str, fn: str) -> str:
    return (f"CASE WHEN {c} = '' THEN {c} ELSE array_to_string(list_transform({_LINES.format(c=c)},"
            f" lambda l: {fn}), chr(10)) || chr(10) END")


sql("map_lines", f"SELECT doc_id, {_map_lines('text', chr(39) + '> ' + chr(39) + ' || l')} AS quoted FROM documents")

sql("rewrite_lines", f"""
SELECT doc_id, lang,
  CASE lang WHEN 'en' THEN {_map_lines('text', "regexp_replace(l, ' {2,}', ' ', 'g')")}
            WHEN 'fr' THEN {_map_lines('text', "regexp_replace(regexp_replace(l, '[ ' || chr(9) || ']+$', '', 'g'), 'e', 'E', 'g')")}
            ELSE text END AS content
FROM documents
""")

sql("rewrite_lines_table", ORACLE["rewrite_lines"])

sql("last_line", f"""
SELECT doc_id, CASE WHEN text = '' THEN '' ELSE coalesce({_LINES.format(c='text')}[-1], '') END AS last_line,
       CAST(CASE WHEN text = '' THEN 0 ELSE len({_LINES.format(c='text')}) END AS INTEGER) AS n_lines
FROM documents
""")

# ------------------------------------------------------------- descriptors
_D = f"(SELECT p_partkey, path FROM {fx('descriptors')})"
_DV = ("(SELECT d.*, p.p_name, p.p_size, v.valid,"
       " v.valid AND d.p_partkey % 11 <> 0 AS named"
       f" FROM {_D} d JOIN part p ON p.p_partkey = d.p_partkey JOIN (SELECT p_partkey, p_partkey % 7 <> 0 AND p_partkey % 13 <> 0"
       " AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AS valid FROM part) v ON v.p_partkey = d.p_partkey)")

_PARSED = f"""
SELECT p_partkey, path, valid, CASE WHEN named THEN replace(p_name, ' ', '-') END AS name_first,
       CASE WHEN named THEN 'app-' || CAST(p_partkey AS VARCHAR) END AS name_last,
       CASE WHEN valid THEN CAST(p_size AS VARCHAR) || '.0' END AS version,
       named AND p_size % 2 = 0 AS db_required
FROM {_DV}
"""
sql("parse_descriptors", _PARSED)
sql("scan_descriptors", f"""
SELECT regexp_extract(path, '([^/]*)$', 1) AS path, valid, name_first, name_last, version, db_required
FROM ({_PARSED}) WHERE p_partkey % 23 <> 0 AND p_partkey % 29 <> 0
""")

sql("plugin_state", f"""
SELECT path, 'app-' || CAST(p_partkey AS VARCHAR) || '.installed' AS key, '1' AS value FROM {_DV} WHERE named
UNION ALL
SELECT path, 'app-' || CAST(p_partkey AS VARCHAR) || '.pool', 'portal' FROM {_DV} WHERE named AND p_size % 2 = 0
""")

sql("descriptor_rejects", f"""
SELECT p_partkey, CASE WHEN NOT valid THEN 'MALFORMED' ELSE 'NO_NAME' END AS reason FROM {_DV} WHERE NOT named
""")

sql("state_lines", """
SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) || '.installed' AS key, '1' AS value FROM labels WHERE quality = 1
UNION ALL
SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) || '.pool', 'portal' FROM labels WHERE quality = 1 AND toxic = 1
""")

# ------------------------------------------------------------------ naming
sql("naming", """
WITH e AS (SELECT event_id, ts, 'app-' || event_type AS base,
             CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'webapp' END AS classifier,
             '1.' || CAST(user_id % 7 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '-SNAPSHOT' ELSE '' END AS version
           FROM events),
f AS (SELECT *, suffix(upper(version), 'SNAPSHOT')
                OR regexp_full_match(version, '(.*)-([0-9]{8}\\.[0-9]{6})-([0-9]+)') AS is_snapshot FROM e)
SELECT event_id,
       concat_ws('-', base, classifier, version, strftime(ts, '%y%m%d-%I%M')) || '.zip' AS archive_name,
       CASE WHEN is_snapshot THEN replace(base || '-' || version, 'SNAPSHOT', strftime(ts, '%Y%m%d.%H%M%S'))
            ELSE base || '-' || version END AS stamp_name,
       CASE WHEN suffix(version, '-SNAPSHOT') THEN split_part(version, '-SNAPSHOT', 1) ELSE version END
         AS release_version,
       is_snapshot
FROM f
""")


def _vfrom(s: str) -> str:
    return (f"CASE WHEN regexp_full_match({s}, '[^-]*-.*-[^-]*')"
            f" THEN regexp_extract({s}, '^[^-]*-(.*)-[^-]*$', 1) END")


sql("version_from", f"""
SELECT o_orderkey, path, {_vfrom("regexp_extract(path, '([^/]*)$', 1)")} AS version_from,
       {_vfrom('path')} AS version_from_path FROM {_S}
""")

# ----------------------------------------------------------------- closure
sql("dependency_closure", f"""
WITH RECURSIVE edges AS (SELECT * FROM {fx('edges_half')} UNION ALL SELECT * FROM {fx('edges_jump')}),
r(node) AS (SELECT node FROM {fx('roots')}
            UNION SELECT e.child FROM r JOIN edges e ON e.parent = r.node)
SELECT node FROM r
""")


# ---------------------------------------------------------------- assemble
_ASM = f"""
WITH L AS (
  SELECT layer, priority, path, mtime, doc_id, NULL::BIGINT AS o_orderkey, content FROM {fx('paths')}
  UNION ALL
  SELECT 'conf', 4, 'WEB-INF/sql/' || file_name, 1700000000000 + o_orderkey * 1000, NULL, o_orderkey, content
  FROM {fx('scripts')}),
seg AS (SELECT *, CASE WHEN priority < 2 THEN 'a' WHEN priority = 2 THEN 'n' ELSE 'r' END AS seg FROM L),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, seg ORDER BY
        CASE WHEN seg = 'n' THEN mtime ELSE priority END DESC NULLS LAST, mtime DESC NULLS LAST,
        doc_id DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS rn FROM seg) WHERE rn = 1),
pick AS (
  SELECT k.path, CASE WHEN r.path IS NOT NULL THEN 'r'
                      WHEN n.path IS NOT NULL AND (a.path IS NULL OR n.mtime > a.mtime) THEN 'n' ELSE 'a' END AS seg
  FROM (SELECT DISTINCT path FROM L) k
  LEFT JOIN w a ON a.seg = 'a' AND a.path = k.path
  LEFT JOIN w n ON n.seg = 'n' AND n.path = k.path
  LEFT JOIN w r ON r.seg = 'r' AND r.path = k.path),
m AS (SELECT w.* FROM w JOIN pick USING (path, seg)),
g AS (SELECT *, CASE WHEN regexp_extract(path, '([^/]*)$', 1) = 'build.properties' THEN 'PASS'
        WHEN NOT suffix(lower(path), '.sql') OR coalesce(strlen(content), 1) = 0 THEN 'DROP'
        WHEN NOT coalesce(regexp_matches(path, '(?i)(^|/)(create|init|update)[^/]*\\.sql$'), false) THEN 'DROP'
        WHEN coalesce(starts_with(content, '-- liquibase formatted sql')
                      OR starts_with(content, '--liquibase formatted sql'), false) THEN 'PASS'
        ELSE 'REJECT' END AS gate FROM m)"""

sql("assemble", f"""{_ASM}
SELECT path, layer, priority, doc_id, o_orderkey, gate FROM g
""")

sql("assemble_late", f"""{_ASM}
SELECT path, layer, priority, doc_id, o_orderkey, gate, md5(content) AS content_md5 FROM g
""")

sql("assemble_readiness", f"""{_ASM}
SELECT count(*) = 0 AS ready, count(*) AS n_rejected FROM g WHERE gate = 'REJECT'
""")

sql("sync_stream", ORACLE["incremental_sync"])

sql("sync_into", ORACLE["incremental_sync"])

sql("deploy_scripts", f"""
WITH v AS (SELECT *, CASE component WHEN 'core' THEN NULL WHEN 'plugin-o' THEN 'mysql' ELSE 'oracle' END
                       AS target_vendor
           FROM {_GATE} WHERE gate = 'PASS')
SELECT o_orderkey, path, target_vendor,
  CASE target_vendor
    WHEN 'mysql' THEN {_map_lines('content', "regexp_replace(l, ' {2,}', ' ', 'g')")}
    WHEN 'oracle' THEN {_map_lines('content', "regexp_replace(regexp_replace(l, '[ ' || chr(9) || ']+$', '', 'g'), 'e', 'E', 'g')")}
    ELSE content END AS content
FROM v
""")


# ----------------------------------------------------------- sources, sinks
sql("scan_files", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
sql("last_line_long", f"""
SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, last_line, CAST(n_lines AS BIGINT) AS n_lines
FROM ({ORACLE['last_line']}) JOIN documents USING (doc_id) WHERE strlen(text) > 0
""")
sql("scan_reported", """
SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, strlen(text) AS length, CASE WHEN strlen(text) > 2000 THEN 'FAILED' ELSE 'OK' END AS status,
       CASE WHEN strlen(text) > 2000 THEN 'OSError: larger than 2000 bytes' END AS reason, CASE WHEN strlen(text) <= 2000 THEN md5(text) END AS content_md5
FROM documents WHERE strlen(text) > 0
""")
sql("scan_scripts", f"SELECT path, content FROM {_S} WHERE strlen(content) > 0")
sql("write_back", f"SELECT path, content FROM ({ORACLE['process_scripts']}) WHERE strlen(content) > 0")
sql("write_scripts", f"SELECT path, action, content FROM ({ORACLE['process_scripts']}) WHERE action IN ('TAGGED', 'FIXED')")
sql("write_state", f"SELECT key, value FROM ({ORACLE['state_lines']})")
sql("write_manifest", f"SELECT package, entry_path, source_path FROM ({ORACLE['package_membership']})")

# ---------------------------------------------------------- script versions
sql("target_version", f"""
SELECT o_orderkey, path, CASE WHEN regexp_full_match(regexp_extract(path, '([^/]*)$', 1), 'update.*-[^-]*\\.sql')
       THEN regexp_extract(path, '-([^-/]*)\\.sql$', 1) END AS target_version FROM {_S}
""")
sql("script_drift", f"""
SELECT component, '1.5.0' AS declared_version, '2.0.0' AS newest_version FROM {_S}
WHERE component <> 'core' AND regexp_matches(file_name, '^update.*-2\\.0\\.0\\.sql$') GROUP BY component
""")
sql("one_per_component", f"""
SELECT d.p_partkey, p_brand, path <> min(path) OVER (PARTITION BY p_brand) AS extra
FROM {_D} d JOIN part p ON p.p_partkey = d.p_partkey
""")


# ------------------------------------------------------------- layer chain
_CHAIN = """(SELECT doc_id, 1 + doc_id % 11 AS priority, source || '/' || CAST(n_chars % 50 AS VARCHAR) AS path,
   CAST(1700000000000 + ((doc_id * 7919) % 1000003) * 1000 AS BIGINT) AS mtime FROM documents)"""


def _chain(skip: str, newer: tuple[int, ...]) -> str:
    """Fold of the segments: runs of replace layers, and each newer layer."""
    segs, lo = [], 0
    for n in newer:
        segs += [("replace", lo, n), ("newer", n, n)]
        lo = n
    segs.append(("replace", lo, 99))
    segs = [s for s in segs if s[0] == "newer" or s[2] - s[1] > 1]
    cond = lambda s: f"priority = {s[1]}" if s[0] == "newer" else f"priority > {s[1]} AND priority < {s[2]}"
    order = "priority DESC, mtime DESC, doc_id DESC"
    parts = ", ".join(f"arg_max(doc_id, rk) FILTER ({cond(s)}) AS d{i}, arg_max(mtime, rk) FILTER ({cond(s)}) AS m{i}" for i, s in enumerate(segs))
    steps, prev = "", "a"
    for i, s in enumerate(segs):
        win = f"d{i} IS NOT NULL" + ("" if s[0] == "replace" else " AND (sd IS NULL OR m%d > sm)" % i)
        src = "(SELECT *, CAST(NULL AS BIGINT) AS sd, CAST(NULL AS BIGINT) AS sm FROM a)" if not i else prev
        steps += f", s{i} AS (SELECT * EXCLUDE (sd, sm), CASE WHEN {win} THEN d{i} ELSE sd END AS sd, CASE WHEN {win} THEN m{i} ELSE sm END AS sm FROM {src})"
        prev = f"s{i}"
    return f"""WITH c AS (SELECT *, -row_number() OVER (PARTITION BY path ORDER BY {order}) AS rk FROM {_CHAIN} {skip}),
a AS (SELECT path, {parts} FROM c GROUP BY path){steps}
SELECT path, doc_id, CASE priority {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_CHAIN_NAMES))} END AS layer
FROM {prev} JOIN (SELECT doc_id, priority FROM c) ON doc_id = sd"""


_CHAIN_NAMES = ("target", "core", "plugins", "sites", "third_party_jars", "build_config", "project", "sql", "site_docs", "classes",
                "default_conf", "local_conf")
sql("assemble_chain", _chain("", (4, 9)))
sql("assemble_chain_update", _chain("", (4, 6, 7, 8, 9)).replace("1 + doc_id % 11 AS priority", "CASE WHEN doc_id % 11 < 3 THEN 0 ELSE 1 + doc_id % 11 END AS priority")
    .replace("priority > 0 AND priority < 4", "priority >= 0 AND priority < 4"))
