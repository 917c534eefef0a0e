"""Version reconciliation: newest per key, COPY / DELETE / SKIP plans, drift.

Versions are compared through ``version_key`` (a struct Spark orders
field by field). Per-key maxima are ``max(struct(key, version))``: a partial
aggregate, so a popular artifact id cannot pile up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import base_name
from strata.functions.versions import version_key

COPY, DELETE, SKIP = "COPY", "DELETE", "SKIP"


def max_version(df: DataFrame, key: Sequence[str], version: str = "version",
                exclude: Column | None = None) -> DataFrame:
    """Highest version per key; null and unparseable versions are ignored;
    rows where ``exclude`` holds (e.g. create scripts) do not count."""
    if exclude is not None:
        df = df.where(~F.coalesce(exclude, F.lit(False)))
    k = version_key(version)
    best = F.max(F.struct(k.alias("k"), F.col(version).alias("v")))
    return (df.where(k.isNotNull()).groupBy(*key).agg(best["v"].alias("max_version")))


def version_reconcile(candidates: DataFrame, current: DataFrame, key: Sequence[str],
                      version: str = "version") -> DataFrame:
    """Plan rows ``(key..., action, version)`` per candidate key.

    Absent from current: COPY. Candidate newer: COPY (new version) and
    DELETE (old version). Same or older: SKIP. A candidate whose version
    cannot be parsed ("null version range"): COPY, without DELETE. A current
    version that cannot be parsed counts as older. Both sides are reduced
    to their newest version per key first (first match only).

    One keyed aggregate over the union of both sides replaces the two
    de-duplications and the join; the version key is computed once per row.
    """
    u = (current.select(*key, F.col(version).alias("_v"), F.lit(0).alias("_side"))
         .unionByName(candidates.select(*key, F.col(version).alias("_v"), F.lit(1).alias("_side")))
         .withColumn("_k", version_key("_v")))
    side, v, k = F.col("_side"), F.col("_v"), F.col("_k")
    best = lambda s: F.max(F.when((side == s) & k.isNotNull(), F.struct(k.alias("k"), v.alias("v"))))
    loose = lambda s: F.min(F.when((side == s) & k.isNull(), v))
    g = u.groupBy(*key).agg(
        best(1).alias("_cb"), loose(1).alias("_cn"), best(0).alias("_ub"), loose(0).alias("_un"),
        F.max((side == 1).cast("int")).alias("_has_c"),
        F.max((side == 0).cast("int")).alias("_has_u"),
    )
    cand = F.coalesce(F.col("_cb.v"), F.col("_cn"))
    cur = F.coalesce(F.col("_ub.v"), F.col("_un"))
    ck, uk = F.col("_cb.k"), F.col("_ub.k")
    row = lambda a, ver: F.struct(F.lit(a).alias("action"), ver.alias("version"))
    plan = (F.when(F.col("_has_u") == 0, F.array(row(COPY, cand)))
            .when(ck.isNull(), F.array(row(COPY, cand)))
            .when(uk.isNull() | (ck > uk), F.array(row(COPY, cand), row(DELETE, cur)))
            .otherwise(F.array(row(SKIP, cand))))
    return (g.where(F.col("_has_c") == 1)
             .select(*key, F.explode(plan).alias("_p"))
             .select(*key, "_p.action", "_p.version"))


def apply_plan(state: DataFrame, plan: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """(state minus DELETE rows) plus COPY rows, as a set of (key..., version).
    A null version is a value like any other."""
    ident = [*key, version]
    deletes = plan.where(F.col("action") == DELETE).select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(ident)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d{i}")) for i, c in enumerate(ident)])
    copies = plan.where(F.col("action") == COPY).select(*ident)
    kept = state.select(*ident).join(deletes, on=same, how="left_anti")
    return kept.unionByName(copies).dropDuplicates(ident)


def accumulate(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch to a state set, no duplicates."""
    return state.unionByName(batch.select(*state.columns)).dropDuplicates()


def version_drift(scripts: DataFrame, components: DataFrame, key: Sequence[str],
                  version: str = "version", declared: str = "declared_version") -> DataFrame:
    """Components whose newest script version exceeds the declared version."""
    newest = max_version(scripts, key, version)
    j = newest.join(components.select(*key, declared), on=list(key), how="inner")
    return (j.where(version_key(F.col("max_version")) > version_key(F.col(declared)))
             .select(*key, declared, F.col("max_version").alias("newest_version")))


def remove_named(target: DataFrame, names: DataFrame, directory: str, path: str = "path",
                 name: str = "name") -> DataFrame:
    """Drop from ``directory`` the files whose base name is listed; absent names are ignored.

    An equi anti-join on (directory, base name): AQE broadcasts ``names``
    when it is small and shuffles both sides otherwise.
    """
    d = directory.rstrip("/")
    t = target.withColumn("_dir", F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1)) \
              .withColumn("_base", base_name(path))
    n = names.select(F.col(name).alias("_base")).distinct().withColumn("_dir", F.lit(d))
    return t.join(n, on=["_dir", "_base"], how="left_anti").drop("_dir", "_base")
