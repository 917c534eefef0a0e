"""Checks and summaries: cardinality, allowed values, readiness, run counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def cardinality_check(df: DataFrame, group: Sequence[str], expected: DataFrame | None = None,
                      min_count: int = 0, max_count: int | None = None,
                      exempt: Column | None = None) -> DataFrame:
    """Per group: ``n`` rows and ``ok`` = min_count <= n <= max_count.

    With ``expected`` (the groups that must be judged, e.g. all projects),
    groups without rows appear with n = 0. ``exempt`` (a predicate on the
    group columns, e.g. "the project is the core itself") makes a group ok
    whatever its count. The count is a partial aggregate; the join sees one
    row per group.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    if expected is not None:
        counts = (expected.select(*group).distinct().join(counts, on=list(group), how="left")
                  .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("bigint"))))
    ok = F.col("n") >= min_count
    if max_count is not None:
        ok = ok & (F.col("n") <= max_count)
    if exempt is not None:
        ok = ok | F.coalesce(exempt, F.lit(False))
    return counts.withColumn("ok", ok)


def assert_cardinality(checked: DataFrame, message: str = "cardinality check failed") -> DataFrame:
    """Fail the job (at run time, inside the tasks) on the first bad group."""
    return checked.withColumn("ok", F.assert_true(F.col("ok"), F.lit(message)).isNull())


def allowed_values(df: DataFrame, col: str, values: Sequence[str], on_fail: str = "flag") -> DataFrame:
    """Value must be one of ``values``.

    ``flag``: add ``allowed`` and ``message`` (null when allowed).
    ``reject``: only the offending rows, with the message.
    ``raise``: fail the job with the message on the first offending row.
    """
    listing = ", ".join(values)
    ok = F.coalesce(F.col(col).isin(*values), F.lit(False))
    msg = F.when(~ok, F.concat(F.lit(f"{col} '"), F.coalesce(F.col(col), F.lit("null")),
                               F.lit(f"' is not allowed; allowed values: {listing}")))
    if on_fail == "raise":
        return df.withColumn(col, F.when(ok, F.col(col)).otherwise(F.raise_error(msg)))
    out = df.withColumn("allowed", ok).withColumn("message", msg)
    return out.where(~ok) if on_fail == "reject" else out


def rejected_paths(df: DataFrame, path: str = "path", rejected: Column | None = None) -> DataFrame:
    """The rejected paths as a distributed, sorted DataFrame (no size limit)."""
    if rejected is not None:
        df = df.where(rejected)
    return df.select(path).orderBy(path)


def readiness(df: DataFrame, path: str = "path", rejected: Column | None = None) -> DataFrame:
    """One row: ``ready`` (no rejected rows) and ``n_rejected``: one partial
    aggregate. The paths themselves are ``rejected_paths``."""
    if rejected is not None:
        df = df.where(rejected)
    return df.agg((F.count(F.lit(1)) == 0).alias("ready"), F.count(F.lit(1)).alias("n_rejected"))


def readiness_state(ready: DataFrame, paths: DataFrame | None = None, path: str = "path") -> DataFrame:
    """(key, value) state rows: the readiness flag, and a row per rejected path."""
    # The keys of the state file.
    flag = ready.select(F.lit("liquibase.readyToRun").alias("key"), F.col("ready").cast("string").alias("value"))
    if paths is None:
        return flag
    return flag.unionByName(paths.select(F.lit("liquibase.fileErrors").alias("key"), F.col(path).alias("value")))


def run_counters(df: DataFrame, layer: str = "layer", action: str = "action") -> DataFrame:
    """Number of rows per (layer, action): copied / updated / skipped per layer."""
    return df.groupBy(layer, action).agg(F.count(F.lit(1)).alias("n"))


def written_counters(df: DataFrame, path: str, name: str = "run", action: str = "action",
                     actions: Sequence[str] = ("NEW", "UPDATED", "UNCHANGED", "TARGET_ONLY")) -> DataFrame:
    """Write ``df`` to ``path`` and return ``action, n``, counted by that write."""
    seen, obs = observe_counters(df, name, action, actions)
    seen.write.parquet(path)
    counted = [(a, obs.get[a.lower()] or 0) for a in actions]
    return df.sparkSession.createDataFrame(counted, "action string, n long")


def observe_counters(df: DataFrame, name: str, action: str = "action",
                     actions: Sequence[str] = ("NEW", "UPDATED", "UNCHANGED", "TARGET_ONLY")):
    """In-flight counters on a DataFrame that is written anyway (no extra job).

    Returns ``(observed_df, observation)``; read ``observation.get`` after
    the write.
    """
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")] + [
        F.sum((F.col(action) == a).cast("long")).alias(a.lower()) for a in actions]
    return df.observe(obs, *metrics), obs
