"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import scratch_path

BROADCAST_KEYS = 1_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: the
    plan above is cut and a lost executor does not lose the rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(keys: DataFrame) -> DataFrame:
    """``keys`` (written rows of a number or two) for a join with whole texts: up to
    ``BROADCAST_KEYS`` (some 100 MB) broadcast, so that no text is shuffled; beyond, as they are."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
