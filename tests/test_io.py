"""Sources and sinks: round trips through a scratch folder."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from strata.operators import descriptors
from strata.sources import files, sinks
from strata.streaming import sync_stream as ss


def _tree():
    d = tempfile.mkdtemp(prefix="strata-io-")
    os.makedirs(f"{d}/sql/sub")
    os.makedirs(f"{d}/plugins")
    for rel, body in {"sql/a.sql": "select 1;\n", "sql/sub/B.SQL": "--liquibase formatted sql\n",
                      "sql/empty.sql": "", "sql/notes.txt": "x", "plugins/p.xml": "<p><name>n</name></p>",
                      "plugins/bad.xml": "<p>", "plugins/r.XML": "<p/>"}.items():
        with open(f"{d}/{rel}", "w") as f:
            f.write(body)
    return d


def test_scan_files_and_scripts(spark):
    d = _tree()
    got = rows(files.scan_files(spark, f"{d}/sql", ext=".sql"), "path", "length")
    assert got == [("a.sql", 10), ("sub/B.SQL", 26)]
    sc = rows(files.scan_scripts(spark, f"{d}/sql"), "path", "content")
    assert sc == [("a.sql", "select 1;\n"), ("sub/B.SQL", "--liquibase formatted sql\n")]
    assert files.scan_files(spark, f"{d}/missing", missing="empty").count() == 0
    tagged = files.scan_files(spark, f"{d}/sql", ext=".sql", layer="core", priority=1)
    assert {(r.layer, r.priority) for r in tagged.collect()} == {("core", 1)}


def test_scan_descriptors_state_and_sink(spark):
    d = _tree()
    dsc = files.scan_descriptors(spark, f"{d}/plugins")
    assert sorted(r.path for r in dsc.collect()) == ["bad.xml", "p.xml"]
    state = descriptors.plugin_state(dsc)
    out = sinks.write_state(state, f"{d}/out/plugins.dat", header=descriptors.STATE_HEADER,
                            line_sep=descriptors.STATE_LINE_SEP)
    text = ""
    for part in sorted(os.listdir(out)):
        if part.startswith("part-"):
            with open(f"{out}/{part}", newline="") as f:
                text += f.read()
    assert text == "\r\n".join(list(descriptors.STATE_HEADER) + ["n.installed=1"]) + "\r\n"


def test_write_scripts_and_manifest(spark):
    d = _tree()
    df = spark.createDataFrame([("a.sql", "TAGGED", "x"), ("b.sql", "IGNORED", "y"), ("c.sql", "FIXED", "z")],
                               "path string, action string, content string")
    out = sinks.write_scripts(df, f"{d}/scripts", dry_run=True)
    assert out.endswith("-dry-run")
    back = spark.read.parquet(out)
    assert rows(back, "path", "action") == [("a.sql", "TAGGED"), ("c.sql", "FIXED")]
    m = spark.createDataFrame([("p1", "e", "s"), ("p2", "f", "t")], "package string, entry_path string, source_path string")
    mo = sinks.write_manifest(m, f"{d}/manifest")
    assert sorted(x for x in os.listdir(mo) if x.startswith("package=")) == ["package=p1", "package=p2"]


def test_stream_sync_agrees_with_batch_and_replays(spark):
    from strata.operators.sync import incremental_sync, latest_per_key
    d = tempfile.mkdtemp(prefix="strata-stream-")
    schema = "k string, ts long, v string"
    spark.createDataFrame([("a", 1, "s1"), ("b", 9, "s1")], schema).write.parquet(f"{d}/in/1")
    spark.createDataFrame([("a", 3, "s2"), ("c", 2, "s2"), ("b", 2, "s2")], schema).write.parquet(f"{d}/in/2")
    target = spark.createDataFrame([("a", 2, "t"), ("b", 5, "t"), ("z", 1, "t")], schema)
    ss.seed_state(target, f"{d}/state", ["k"], "ts", buckets=8)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{d}/in"))
    q = ss.sync_stream(stream, f"{d}/state", f"{d}/ckpt", ["k"], "ts", buckets=8)
    q.awaitTermination()
    streamed = ss.read_state(spark, f"{d}/state").select("k", "ts", "v")
    allsrc = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    batch = incremental_sync(latest_per_key(allsrc, ["k"], "ts"), target, ["k"], "ts")
    assert rows(streamed) == rows(batch) == [("a", 3, "s2"), ("b", 9, "s1"), ("c", 2, "s2"), ("z", 1, "t")]
    # replaying a batch after the fact leaves the state unchanged
    ss.sync_batch(spark.createDataFrame([("a", 3, "s2"), ("c", 2, "s2"), ("b", 2, "s2")], schema),
                  f"{d}/state", ["k"], "ts", ["k", "ts", "v"], buckets=8)
    assert rows(ss.read_state(spark, f"{d}/state").select("k", "ts", "v")) == rows(batch)


def test_scan_roots_bytes_and_listing(spark):
    d = _tree()
    with open(f"{d}/sql/latin.sql", "wb") as f:
        f.write(b"-- caf\xe9\n")
    got = {r.path: r.content for r in files.scan_scripts(spark, f"file://{d}/sql").collect()}
    assert got["a.sql"] == "select 1;\n" and got["latin.sql"] == "-- caf\ufffd\n" and "sub/B.SQL" in got
    assert rows(files.scan_files(spark, f"{d}/sql/", ext=".txt"), "path") == [("notes.txt",)]


def test_stream_reads_a_table_of_many_files(spark):
    d = tempfile.mkdtemp(prefix="strata-stream-")
    schema = "k string, ts long, v string"
    spark.range(90).selectExpr("CAST(id % 30 AS STRING) AS k", "id AS ts", "'v' AS v").repartition(3).write.parquet(f"{d}/events.parquet")
    ss.seed_state(spark.createDataFrame([("0", 0, "t")], schema), f"{d}/state", ["k"], "ts", buckets=4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/event[s].parquet")
    ss.sync_stream(stream, f"{d}/state", f"{d}/ckpt", ["k"], "ts", buckets=4).awaitTermination()
    assert rows(ss.read_state(spark, f"{d}/state").select("k", "ts")) == sorted((str(i), i + 60) for i in range(30))
