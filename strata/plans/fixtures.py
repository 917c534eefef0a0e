"""Inputs derived from the provided tables, in the shapes the operators take.

The provided tables are TPC-H-like; the operators work on files, scripts,
artifacts and descriptors. Each fixture below is a projection (plus an
optional filter) of one whole table, written once as SQL expressions that
both Spark (``selectExpr``) and DuckDB accept, so the oracle and the Spark
query read identical inputs and only the operator logic differs. Every
fixture is narrow (no shuffle) and grows with its table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strata.sources.tables import table


@dataclass(frozen=True)
class Fixture:
    table: str
    select: tuple[str, ...]
    where: str | None = None

    def sql(self) -> str:
        w = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {', '.join(self.select)} FROM {self.table}{w}"


NL, TAB = "chr(10)", "chr(9)"

FIXTURES: dict[str, Fixture] = {
    # Three layers of lineitem keyed by (l_orderkey, l_linenumber), which repeats.
    "layers": Fixture("lineitem", (
        "l_orderkey", "l_linenumber", "l_returnflag AS layer",
        "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS priority",
        "l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity")),
    # Event snapshots; every event is on a side. Signups exist in the source only (new keys),
    # errors in the target only; of other types the target holds what came before 2024-01-20,
    # the source what came since 2024-01-10 (updated and unchanged keys).
    "events_target": Fixture("events", ("user_id", "event_type", "event_id", "ts", "value"),
                             "event_type = 'error' OR (event_type <> 'signup' AND ts < TIMESTAMP '2024-01-20 00:00:00')"),
    "events_source": Fixture("events", ("user_id", "event_type", "event_id", "ts", "value"),
                             "event_type = 'signup' OR (event_type <> 'error' AND ts >= TIMESTAMP '2024-01-10 00:00:00')"),
    # Artifacts with versions "size.brand", some with a qualifier or a long build number, key (group_id, artifact_id).
    "part_versions": Fixture("part", (
        "p_partkey", "p_type AS group_id", "p_name AS artifact_id",
        "CAST(substr(p_brand, 7) AS INT) AS brand_no", "p_size AS size",
        "CAST(p_size AS STRING) || '.' || substr(p_brand, 7)"
        " || CASE WHEN p_partkey % 3 = 0 THEN '-SNAPSHOT' WHEN p_partkey % 7 = 1 THEN '.0.Final'"
        " WHEN p_partkey % 7 = 2 THEN 'b2' WHEN p_partkey % 7 = 3 THEN '.20230101123456' WHEN p_partkey % 7 = 4 THEN '-jre'"
        " WHEN p_partkey % 7 = 5 THEN '-android' ELSE '' END AS version")),
    # SQL scripts, six content variants, five file-name shapes.
    "scripts": Fixture("orders", (
        "o_orderkey",
        "CASE o_orderstatus WHEN 'F' THEN 'core' ELSE 'plugin-' || lower(o_orderstatus) END AS component",
        "CASE o_orderkey % 5"
        " WHEN 0 THEN 'create_db_' || CAST(o_orderkey AS STRING) || '.sql'"
        " WHEN 1 THEN 'init_db_' || CAST(o_orderkey AS STRING) || '.sql'"
        " WHEN 2 THEN 'update_db_' || CAST(o_orderkey AS STRING) || '-1.' || CAST(o_custkey % 4 AS STRING)"
        " || '.0-2.0.0.sql'"
        " WHEN 3 THEN 'update_db_' || CAST(o_orderkey AS STRING) || '-2.0.0.sql'"
        " ELSE 'notes_' || CAST(o_orderkey AS STRING) || '.sql' END AS file_name",
        "CASE o_orderkey % 6"
        f" WHEN 0 THEN 'INSERT INTO orders_' || lower(o_orderstatus) || ' VALUES (' || CAST(o_orderkey AS STRING)"
        f" || ', ' || CAST(o_custkey AS STRING) || ');' || {NL}"
        f" || CASE WHEN o_custkey % 2 = 1 THEN '--changeset later' || {NL} ELSE '' END"
        f" WHEN 1 THEN '-- liquibase formatted sql' || {NL} || '-- changeset x:' || CAST(o_orderkey AS STRING)"
        f" || {NL} || 'UPDATE t SET p = ''' || o_orderpriority || ''';' || {NL}"
        f" WHEN 2 THEN '--liquibase formatted sql' || {NL} || '--changeset x:' || CAST(o_orderkey AS STRING)"
        f" || {NL} || '--preconditions onFail:MARK_RAN' || {NL} || 'DELETE FROM t WHERE id = '"
        f" || CAST(o_orderkey AS STRING) || ';' || {NL}"
        f" WHEN 3 THEN ' ' || {TAB} || {NL} || repeat(' ', CAST(o_custkey % 3 AS INT)) || {NL}"
        " WHEN 4 THEN 'Order ' || CAST(o_orderkey AS STRING) || ' placed by customer '"
        " || CAST(o_custkey AS STRING) || ' with priority ' || o_orderpriority"
        f" ELSE '-- TODO select the right ' || o_orderpriority || {NL} END AS content")),
    # File entries from documents: a directory shape by doc_id % 12, a name shape by doc_id % 5.
    "paths": Fixture("documents", (
        "doc_id",
        "CASE doc_id % 12"
        " WHEN 0 THEN ''"
        " WHEN 1 THEN 'src/sql/plugins/' || source || '/'"
        " WHEN 2 THEN 'webapp/WEB-INF/lib/'"
        " WHEN 3 THEN 'WEB-INF/lib/'"
        " WHEN 4 THEN source || '/.svn/' || lang || '/'"
        " WHEN 5 THEN 'src/java/fr/paris/lutece/plugins/' || source || '/business/'"
        " WHEN 6 THEN 'webapp/WEB-INF/classes/' || lang || '/'"
        " WHEN 7 THEN source || '/' || lang || '/resources/'"
        " WHEN 8 THEN 'site/user/' || lang || '/'"
        " WHEN 9 THEN 'src/site/xdoc/'"
        " WHEN 10 THEN 'src/site/resources/images/'"
        " ELSE 'target/' || source || '/tech/' END"
        " || CASE doc_id % 5"
        " WHEN 0 THEN 'create_' || lang || '_' || CAST(doc_id AS STRING) || '.sql'"
        " WHEN 1 THEN 'init_' || CAST(doc_id AS STRING) || '.SQL'"
        " WHEN 2 THEN 'update_db_' || source || '-1.' || CAST(doc_id % 3 AS STRING) || '.0-2.0.0.sql'"
        " WHEN 3 THEN 'plugin_' || CAST(doc_id AS STRING) || '.xml'"
        " ELSE 'package.html' END AS path",
        "CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'plugins' ELSE 'site' END AS layer",
        "CAST(doc_id % 3 + 1 AS INT) AS priority",
        "n_chars AS length",
        "CAST(1700000000000 + ((doc_id * 7919) % 1000003) * 1000 AS BIGINT) AS mtime",
        "text AS content")),
    # Plugin descriptors: well-formed with a nested second <name>, nameless, unclosed, with text or
    # a second root behind the first, or with a byte-order mark.
    "descriptors": Fixture("part", (
        "p_partkey",
        "'webapp/WEB-INF/plugins/plugin_' || CAST(p_partkey AS STRING) || '.xml' AS path",
        "CASE WHEN p_partkey % 7 = 0 THEN '<plug-in><name>' || p_name || '</name>'"
        " WHEN p_partkey % 13 = 0 THEN '<plug-in><name>' || p_name || '</name></plug-in> trailing'"
        " WHEN p_partkey % 17 = 0 THEN '<plug-in><name>a</name></plug-in><plug-in><name>b</name></plug-in>'"
        " WHEN p_partkey % 19 = 0 THEN chr(65279) || '<plug-in><name>' || p_name || '</name></plug-in>'"
        " WHEN p_partkey % 11 = 0 THEN '<plug-in><version>' || CAST(p_size AS STRING) || '.0</version></plug-in>'"
        " ELSE '<plug-in><name>' || replace(p_name, ' ', '-') || '</name><version>' || CAST(p_size AS STRING)"
        " || '.0</version><db-pool-required>' || CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END"
        " || '</db-pool-required><application><name>app-' || CAST(p_partkey AS STRING)"
        " || '</name></application></plug-in>' END AS xml")),
    # Dependency edges of every part: k -> floor(k / 2) and k -> floor(7k / 3) (cycles; what lies
    # beyond the table has no edges).
    "edges_half": Fixture("part", ("p_partkey AS parent", "CAST(floor(p_partkey / 2) AS BIGINT) AS child")),
    "edges_jump": Fixture("part", ("p_partkey AS parent", "CAST(floor(7 * p_partkey / 3) AS BIGINT) AS child")),
    "roots": Fixture("part", ("p_partkey AS node",), "p_size = 1"),
    # Artifacts: lineitem rows as (group, id, version, type, scope); scope null on line 7.
    "artifacts": Fixture("lineitem", (
        "l_orderkey", "l_linenumber",
        "'g' || CAST(l_suppkey % 10 AS STRING) AS group_id",
        "CASE l_partkey % 50 WHEN 0 THEN 'lutece-core' WHEN 1 THEN 'servlet-api' WHEN 2 THEN 'junit'"
        " ELSE 'lib-' || CAST(l_partkey AS STRING) END AS artifact_id",
        "CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey % 10 AS STRING) AS version",
        "CASE WHEN l_partkey % 50 = 0 THEN 'lutece-core' WHEN l_suppkey % 4 = 2 THEN 'lutece-plugin'"
        " WHEN l_suppkey % 4 = 3 THEN 'lutece-site' ELSE 'jar' END AS type",
        "CASE l_linenumber WHEN 1 THEN 'compile' WHEN 2 THEN 'runtime' WHEN 3 THEN 'provided'"
        " WHEN 4 THEN 'test' WHEN 5 THEN 'compile' WHEN 6 THEN 'system' END AS scope")),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    f = FIXTURES[name]
    df = table(spark, sf_dir, f.table)
    if f.where:
        df = df.where(f.where)
    return df.selectExpr(*f.select)


def fixture_sql(name: str) -> str:
    """The same fixture as a DuckDB subquery."""
    return "(" + FIXTURES[name].sql() + ")"
