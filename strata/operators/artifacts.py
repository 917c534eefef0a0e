"""Artifact-set filters and database-vendor routing.

Negative tests follow the JVM's ``"x".equals(null) == false``: a null scope
*passes* a "scope is not provided/test" filter and *fails* a "scope is
runtime/compile" filter. Plain SQL three-valued logic would drop both, so
every equality is wrapped in ``coalesce(..., false)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
CORE_TYPE, PLUGIN_TYPE, SITE_TYPE = "lutece-core", "lutece-plugin", "lutece-site"
CORE_ID, SERVLET_API, JUNIT = "lutece-core", "servlet-api", "junit"
SCOPE_COMPILE, SCOPE_RUNTIME, SCOPE_PROVIDED, SCOPE_TEST = "compile", "runtime", "provided", "test"
VENDOR_NONE, VENDOR_AUTO = "none", "auto"
DATABASE_VENDORS = ("hsqldb", "mysql", "oracle", "postgresql")
# ---------------------------------------------------------------------------


def is_(c: str, *values: str) -> Column:
    """Null-safe membership: false (never null) when the column is null."""
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def artifact_filter(df: DataFrame, predicate: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Generic filter; the predicate is a Column or a function of the DataFrame."""
    return df.where(predicate(df) if callable(predicate) else predicate)


def by_type(df: DataFrame, type_: str) -> DataFrame:
    return df.where(is_("type", type_))


def third_party(df: DataFrame) -> DataFrame:
    """Jars in compile or runtime scope (null scope fails)."""
    return df.where(is_("type", "jar") & is_("scope", SCOPE_RUNTIME, SCOPE_COMPILE))


def direct_dependency(df: DataFrame) -> DataFrame:
    """Neither core nor plugin type; scope neither provided nor test (null passes)."""
    return df.where(~is_("type", CORE_TYPE, PLUGIN_TYPE) & ~is_("scope", SCOPE_PROVIDED, SCOPE_TEST))


def transitive_dependency(df: DataFrame) -> DataFrame:
    """Scope neither provided nor test; id neither junit nor servlet-api."""
    return df.where(~is_("scope", SCOPE_PROVIDED, SCOPE_TEST) & ~is_("artifact_id", JUNIT, SERVLET_API))


def multi_module_filter(df: DataFrame) -> DataFrame:
    """Id neither core nor servlet-api; scope neither provided nor test."""
    return df.where(~is_("artifact_id", CORE_ID, SERVLET_API) & ~is_("scope", SCOPE_PROVIDED, SCOPE_TEST))


def vendor_route(df: DataFrame, requested: str = "vendor", configured: Column | str | None = None) -> DataFrame:
    """Resolve the database vendor per row.

    ``none`` (or null): no line rules, status PASS. ``auto``: the configured
    vendor. One of the four known names: itself. Anything else: status
    ERROR with a message (the caller can ``raise_error`` on it or route the
    rows aside). Adds ``target_vendor``, ``route_status``, ``route_error``.
    """
    r = F.col(requested)
    conf = F.col(configured) if isinstance(configured, str) else (configured if configured is not None
                                                                  else F.lit(None).cast("string"))
    vendor = (F.when(r.isNull() | (r == VENDOR_NONE), F.lit(None).cast("string"))
              .when(r == VENDOR_AUTO, conf)
              .when(r.isin(*DATABASE_VENDORS), r))
    status = (F.when(r.isNull() | (r == VENDOR_NONE), F.lit("PASS"))
              .when((r == VENDOR_AUTO) & conf.isNull(), F.lit("ERROR"))
              .when((r == VENDOR_AUTO) | r.isin(*DATABASE_VENDORS), F.lit("ROUTED"))
              .otherwise(F.lit("ERROR")))
    err = F.when(status == "ERROR", F.concat(F.lit("no such database vendor: '"), F.coalesce(
        F.when(r == VENDOR_AUTO, conf), r, F.lit("")), F.lit("'")))
    return df.withColumn("target_vendor", vendor).withColumn("route_status", status).withColumn("route_error", err)
