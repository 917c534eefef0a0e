"""Sinks: changed scripts, key=value state files, package manifests.

Writers are plain DataFrame writers (each task writes its own part files),
so nothing funnels through the driver or a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.text import FIXED, TAGGED
from strata.sources.text_files import write_text_files


def write_scripts(df: DataFrame, dest: str, dry_run: bool = False, dry_run_dest: str | None = None,
                  mode: str = "overwrite") -> str:
    """Write the TAGGED and FIXED scripts as ``(path, action, content)`` parquet,
    partitioned by action (rebalanced first, see ``write_manifest``);
    ``dry_run`` only changes the destination."""
    out = dry_run_dest if dry_run and dry_run_dest else (dest.rstrip("/") + "-dry-run" if dry_run else dest)
    (df.where(F.col("action").isin(TAGGED, FIXED)).select("path", "action", "content")
       .hint("rebalance", "action").write.mode(mode).partitionBy("action").parquet(out))
    return out


def write_back(df: DataFrame, root: str, dry_run: bool = False, dry_run_dest: str | None = None, spare: str | None = None) -> str:
    """Write the TAGGED and FIXED scripts as files at their relative ``path``:
    over the tree under ``root``, or with ``dry_run`` beside it (``dry_run_dest``,
    else ``root`` with ``-dry-run``). Other files of the tree stay as they are.
    ``spare``: a folder of spare files for trees that come and go (see ``text_files``)."""
    out = (dry_run_dest or root.rstrip("/") + "-dry-run") if dry_run else root
    return write_text_files(df.where(F.col("action").isin(TAGGED, FIXED)), out, spare=spare)


def write_state(df: DataFrame, dest: str, header: Sequence[str] = (), key: str = "key", value: str = "value",
                mode: str = "overwrite", order: Sequence[str] = (), line_sep: str = "\n") -> str:
    """Write ``key=value`` text lines, preceded by literal header lines.

    ``line_sep``: line terminator (plugin state files use CRLF, see
    ``descriptors.STATE_LINE_SEP``).

    Header lines go first in sort order (they get ``_seq`` 0); rows follow
    in ``order`` (default: by key). The range sort keeps the write parallel:
    part files are in order, each written by its own task.
    """
    spark = df.sparkSession
    body = df.select(F.lit(1).alias("_seq"), *[F.col(o) for o in order],
                     F.concat_ws("=", F.col(key), F.col(value)).alias("value"))
    sort_cols = ["_seq", *order] if order else ["_seq", "value"]
    if header:
        h = spark.createDataFrame([(0, i, line) for i, line in enumerate(header)], "_seq int, _h int, value string")
        body = body.withColumn("_h", F.lit(0))
        body = h.unionByName(body, allowMissingColumns=True)
        sort_cols = ["_seq", "_h", *(order or ["value"])]
    body.orderBy(*sort_cols).select("value").write.mode(mode).option("lineSep", line_sep).text(dest)
    return dest


def write_manifest(df: DataFrame, dest: str, mode: str = "overwrite") -> str:
    """One output group (folder) per package.

    ``rebalance`` clusters rows by package before the write (few files per
    package instead of one per task and package); AQE splits a package that
    holds a large share of the rows across several tasks.
    """
    df.hint("rebalance", "package").write.mode(mode).partitionBy("package").parquet(dest)
    return dest
