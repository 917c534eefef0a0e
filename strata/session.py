"""Session helpers: a local session for tests/bench, and the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings for large clusters; ``get_session`` applies them unless the master is
# local (spark-submit and keyword arguments override them).
# Shuffle partitions start high and AQE coalesces them to the advisory size,
# so one setting serves small and 100 TB inputs; skewed partitions (a hot
# key holding a large share of rows) are split at run time for joins; file
# splits of 256 MB keep scan tasks in the low tens of thousands at 100 TB.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
}


def get_session(master: str | None = None, app: str = "strata",
                shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect.

    On a cluster, pass nothing: master and resources come from spark-submit.
    ``shuffle_partitions`` defaults to twice the cores in local mode; AQE
    coalesces small partitions and splits skewed ones at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if not (master or "").startswith("local"):
        settings = {**SCALE_SETTINGS, **settings}
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    That is ``spark.checkpoint.dir`` (or the context's checkpoint folder). Where
    neither is set, as in tests, a folder in the warehouse is used, which driver
    and executors share as well.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str = "table", *by: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    The plan above is cut, nothing is kept on executors, and a lost executor
    does not lose the rows. ``by``: columns with a folder for each value.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
