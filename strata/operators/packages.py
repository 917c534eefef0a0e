"""Release and upgrade packages of SQL scripts, with a default when nothing matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.globs import PROFILES, selected
from strata.functions.versions import version_from

RELEASE_PREFIX, UPGRADE_PREFIX = "release-", "upgrade-"
NO_FROM_VERSION = "no from-version"


def or_default(df: DataFrame, default: dict) -> DataFrame:
    """``df``, or one default row when ``df`` is empty.

    Distributed: the default row is anti-joined with at most one row of
    ``df`` (``limit(1)``), so no count and no collect.
    """
    spark = df.sparkSession
    d = spark.createDataFrame([tuple(default.get(c) for c in df.columns)], df.schema)
    probe = df.limit(1).select(F.lit(1).alias("_k"))
    guarded = d.withColumn("_k", F.lit(1)).join(probe, on="_k", how="left_anti").drop("_k")
    return df.unionByName(guarded)


def or_default_per_group(keys: DataFrame, matches: DataFrame, on: list[str], fill: dict[str, Column]) -> DataFrame:
    """Per key: its matches, or one row of defaults when it has none (left join + coalesce)."""
    j = keys.join(matches, on=on, how="left")
    for c, v in fill.items():
        j = j.withColumn(c, F.coalesce(F.col(c), v))
    return j


def release_packages(files: DataFrame, version: str, path: str = "path") -> DataFrame:
    """Create/init scripts go to ``release-<version>``."""
    rel = PROFILES["release"]
    return (files.where(selected(path, rel["include"], rel["exclude"]))
                 .select(F.lit(RELEASE_PREFIX + version).alias("package"),
                         F.col(path).alias("entry_path"), F.col(path).alias("source_path")))


def upgrade_rejects(files: DataFrame, version: str, path: str = "path", use_path: bool = False) -> DataFrame:
    """``path, reason`` of the ``update*<version>.sql`` scripts that go into no
    upgrade package, as their name (with ``use_path`` their path) has no from-version."""
    ups = files.where(selected(path, [f"**/update*{version}.sql"], None))
    return ups.where(version_from(F.col(path), use_path=use_path).isNull()).select(F.col(path).alias("path"), F.lit(NO_FROM_VERSION).alias("reason"))


def upgrade_packages(files: DataFrame, version: str, from_version: str, path: str = "path",
                     use_path: bool = False) -> DataFrame:
    """Each ``update*<version>.sql`` goes to ``upgrade-<from>-<version>``, where
    <from> is read from the script's name (scripts that have none are the rows of
    ``upgrade_rejects``); with no such script at all, one
    empty ``upgrade-<from_version>-<version>`` package row (null entry)."""
    ups = files.where(selected(path, [f"**/update*{version}.sql"], None))
    frm = version_from(F.col(path), use_path=use_path)
    pk = (ups.where(frm.isNotNull())
             .select(F.concat(F.lit(UPGRADE_PREFIX), frm, F.lit("-" + version)).alias("package"),
                     F.col(path).alias("entry_path"), F.col(path).alias("source_path")))
    # The default applies only when no script matched the include at all.
    any_match = ups.limit(1).select(F.lit(1).alias("_k"))
    d = (files.sparkSession.range(1)
         .select(F.lit(1).alias("_k"), F.lit(f"{UPGRADE_PREFIX}{from_version}-{version}").alias("package"),
                 F.lit(None).cast("string").alias("entry_path"), F.lit(None).cast("string").alias("source_path"))
         .join(any_match, on="_k", how="left_anti").drop("_k"))
    return pk.unionByName(d)
