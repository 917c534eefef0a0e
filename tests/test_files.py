"""The file writer, late contents and reports of what is left out."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from strata.operators import assemble, overlay, packages, patterns
from strata.plans import catalog
from strata.sources import files, sinks
from strata.sources.text_files import checked, linked, remove_spare_files, remove_text_files, write_text_files


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8", newline="").read()
            for d, _, names in os.walk(root) for f in names}


def test_files_are_written_at_their_paths(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("a/b/x.sql", "é\r\n1"), ("y.sql", ""), ("a/z.sql", None), ("./a//w.sql", "w")], "path string, content string")
    write_text_files(df.repartition(3), root)
    assert tree(root) == {"a/b/x.sql": "é\r\n1", "y.sql": "", "a/z.sql": "", "a/w.sql": "w"}
    write_text_files(df.limit(0), root)
    write_text_files(spark.createDataFrame([("y.sql", "new")], "path string, content string"), "file://" + root)
    assert tree(root) == {"a/b/x.sql": "é\r\n1", "y.sql": "new", "a/z.sql": "", "a/w.sql": "w"}
    assert not [n for n in os.listdir(root) if n.startswith("_staging")]


@pytest.mark.parametrize("path", [None, "", "../x", "/etc/x", "a/../../x", "a/", "."])
def test_paths_out_of_the_tree_are_refused(path):
    with pytest.raises(ValueError):
        checked(path)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    write_text_files(spark.createDataFrame([("a.sql", "old")], "path string, content string"), root)
    bad = spark.createDataFrame([("a.sql", "new"), ("b.sql", "new"), ("../c.sql", "new")], "path string, content string").coalesce(1)
    with pytest.raises(Exception, match="not a relative path"):
        write_text_files(bad, root)
    assert tree(root) == {"a.sql": "old"} and os.listdir(root) == ["a.sql"]


def test_write_back_and_dry_run(spark, tmp_path):
    root = str(tmp_path / "tree")
    df = spark.createDataFrame([("a.sql", "one", "TAGGED"), ("b/c.sql", "two", "FIXED"), ("d.sql", "three", "IGNORED")], "path string, content string, action string")
    write_text_files(df.select("path", F.lit("old").alias("content")), root)
    beside = sinks.write_back(df, root, dry_run=True)
    assert set(tree(root).values()) == {"old"} and tree(beside) == {"a.sql": "one", "b/c.sql": "two"}
    sinks.write_back(df, root)
    assert tree(root) == {"a.sql": "one", "b/c.sql": "two", "d.sql": "old"}
    assert rows(files.scan_scripts(spark, root), "path", "content") == [("a.sql", "one"), ("b/c.sql", "two"), ("d.sql", "old")]


@pytest.mark.parametrize("newer", [[], [2]])
def test_late_overlay_equals_the_plain_one(spark, tmp_path, newer):
    kinds = "priority int, path string, mtime long, content string"
    parts = []
    for p in (1, 2, 3):
        data = [(p, f"f{i % 37 * p}", (i * 7919 + p) % 50 if i % 9 else None, f"text {p} {i}") for i in range(200)] + [(p, None, p, None), (p, "hot", 1, "same")]
        at = str(tmp_path / f"layer{p}")
        spark.createDataFrame(data, kinds).dropDuplicates(["path", "mtime"]).repartition(3).write.parquet(at)
        parts.append(spark.read.parquet(at))
    more = dict(tiebreak=["mtime"], newer=newer, ts="mtime")
    plain = overlay.layered_overlay(overlay.union_layers(*parts), ["path"], **more)
    late = overlay.layered_overlay_late(overlay.union_layers(*map(overlay.with_position, parts)), ["path"], ["content"], **more)
    assert late.columns == plain.columns and rows(late) == rows(plain)
    with pytest.raises(ValueError):
        overlay.layered_overlay_late(late, ["path"], ["mtime"], ts="mtime")


def test_late_contents_of_scanned_files(spark, tmp_path):
    for name, text in (("core", "core"), ("site", "-- liquibase formatted sql\nsite")):
        write_text_files(spark.createDataFrame([("create_a.sql", text), (f"only_{name}.txt", name)], "path string, content string"), str(tmp_path / name))
    layers = [files.scan_files(spark, str(tmp_path / n), layer=n, priority=i) for i, n in enumerate(("core", "site"))]
    out = assemble.assemble_late(layers, tiebreak=["mtime"], by_row=False)
    assert rows(out, "path", "layer", "gate") == [("create_a.sql", "site", "PASS"), ("only_core.txt", "core", "DROP"), ("only_site.txt", "site", "DROP")]


def test_null_paths_stay_in_both_forms_of_purge(spark):
    df = spark.createDataFrame([("a/b",), ("c",), (None,)], "path string")
    by_table = patterns.purge(df, "path", spark.createDataFrame([("a",), (None,)], "root string"))
    assert rows(patterns.purge(df, "path", ["a"])) == rows(by_table) == [("c",), (None,)]
    assert rows(patterns.purge(df, "path", includes=["**/b"])) == [("c",), (None,)]
    assert rows(patterns.path_exclude(df, "path")) == [("a/b",), ("c",), (None,)]


def test_scripts_without_a_from_version_are_reported(spark):
    df = spark.createDataFrame([("x/update_db_a-1.0.0-2.0.0.sql",), ("x/update2.0.0.sql",), ("x/update_db-2.0.0.sql",), ("x/create_2.0.0.sql",), (None,)], "path string")
    taken, left = packages.upgrade_packages(df, "2.0.0", "1.0.0"), packages.upgrade_rejects(df, "2.0.0")
    assert rows(taken, "source_path") == [("x/update_db_a-1.0.0-2.0.0.sql",)]
    assert rows(left) == [("x/update2.0.0.sql", "no from-version"), ("x/update_db-2.0.0.sql", "no from-version")]


SMALL = [(f"d{i % 7}/e{i % 3}/f{i}.sql", f"line {i}\n-- é") for i in range(2000)]


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("many") / "tree")
    write_text_files(spark.createDataFrame(SMALL, "path string, content string").repartition(4, "path"), root)
    for name in (".hid.sql", "_hid.sql", "note.txt", "d0/_hid/x.sql"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write("x")
    return root


def few_tasks(df):
    """As many tasks as cores at most, not one for each few dozen files."""
    return df.rdd.getNumPartitions() <= df.sparkSession.sparkContext.defaultParallelism


def test_scripts_of_many_small_files(spark, many):
    found = files.scan_scripts(spark, many)
    assert few_tasks(found) and rows(found) == sorted(SMALL, key=repr)


def test_descriptors_of_one_large_folder(spark, tmp_path):
    root = str(tmp_path / "plugins")
    want = [(f"p{i}.xml", f"<p>{i}</p>") for i in range(1500)]
    write_text_files(spark.createDataFrame([*want, ("more/x.xml", "<p/>"), ("k=1/y.xml", "<p/>"), ("u.XML", "<p/>"), ("empty.xml", "")], "path string, content string"), root)
    found = files.scan_descriptors(spark, root)
    assert files.scan_files_reported(spark, root, ext="empty.xml", min_size=0).count() == 0  # as in scan_files, empty files are not listed
    assert few_tasks(found) and rows(found) == sorted(want, key=repr)


def test_reports_of_many_small_files(spark, many):
    found = files.scan_files_reported(spark, many, ext=".SQL", max_size=12)
    assert few_tasks(found)
    want = [(p, len(t.encode()), "OK" if len(t.encode()) <= 12 else "FAILED", t.encode() if len(t.encode()) <= 12 else None) for p, t in SMALL]
    assert rows(found, "path", "length", "status", "content") == sorted(want, key=repr)


def test_lines_of_many_small_files(spark, many):
    found = files.scan_lines(spark, many, ext=".sql")
    assert few_tasks(found)
    assert rows(files.last_lines(found)) == sorted(((p, "-- é", 2) for p, _ in SMALL), key=repr)


def test_lines_are_cut_as_by_the_text_reader(spark, tmp_path):
    (tmp_path / "a b[1].txt").write_bytes(b"\xef\xbb\xbfone\rtwo\r\n\nthree\x0bfour\xff\n\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    got = files.scan_lines(spark, str(tmp_path)).orderBy("path", "block", "at").select("path", F.hex("line").alias("line")).collect()
    want = spark.read.text(str(tmp_path)).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("path"), F.hex("value").alias("line")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 5


def test_odd_paths_are_written_and_listed(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("a\nb/%20 é.sql", "1"), ("c.sql", "first"), ("./c.sql", "last"), ("k=v/_x=1.sql", "2")], "path string, content string")
    write_text_files(df.coalesce(1), root)
    assert rows(files.scan_scripts(spark, root)) == sorted([("a\nb/%20 é.sql", "1"), ("c.sql", "last"), ("k=v/_x=1.sql", "2")], key=repr)
    assert rows(files.scan_scripts(spark, root, ext=".none")) == [] and rows(files.scan_descriptors(spark, root + "/gone")) == []


def test_a_tree_larger_than_a_round_is_gone_over_in_rounds(spark, monkeypatch):
    """Disk holds one round's files; every row is still written and scanned."""
    want = [(f"p{i % 5}/f{i}.sql", f"text {i} é") for i in range(120)]
    df = spark.createDataFrame([*want, ("p0/empty.sql", ""), ("p1/null.sql", None), ("p0/f0.sql", want[0][1])], "path string, content string").repartition(3)
    monkeypatch.setattr(catalog, "ROUND_BYTES", 20 * 5120)
    roots, most = [], []

    def job(root):
        roots.append(root.removeprefix("file:"))
        most.append(len(tree(roots[-1])))
        return files.scan_scripts(spark, root).select("path", "content")

    out = catalog._over_tree(spark, df, "rounds", job)
    assert rows(out) == sorted(want, key=repr)
    assert len(roots) == 7 and max(most) < 60 and sum(most) == 122
    assert not any(map(os.path.exists, roots))


def test_queries_over_trees_give_the_same_rows_in_rounds(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    for name in ("scan_scripts", "write_back"):
        whole = rows(catalog.REGISTRY[name](spark, sf))
        with monkeypatch.context() as m:
            m.setattr(catalog, "ROUND_BYTES", 1 << 22)
            assert rows(catalog.REGISTRY[name](spark, sf)) == whole


def test_a_null_path_fails_in_rounds_too(spark, monkeypatch):
    monkeypatch.setattr(catalog, "ROUND_BYTES", 5120)
    df = spark.createDataFrame([("a.sql", "1"), ("b.sql", "2"), (None, "3")], "path string, content string")
    with pytest.raises(Exception, match="without a path"):
        catalog._over_tree(spark, df, "rounds", lambda root: files.scan_scripts(spark, root))


def test_rounds_write_over_the_files_of_the_last_round(spark, monkeypatch):
    """Files are not made and freed anew for each round, and no spare file is left."""
    df = spark.createDataFrame([(f"p{i % 5}/f{i}.sql", f"{i} " + "é" * (i * 37 % 90)) for i in range(400)], "path string, content string").repartition(3)
    monkeypatch.setattr(catalog, "ROUND_BYTES", 40 * 5120)
    held, roots = {}, []

    def job(root):
        roots.append(root.removeprefix("file:"))
        if len(roots) == 1:  # open files of the first round: nothing but writing over them changes what they hold
            for d, _, names in os.walk(roots[0]):
                for f in names:
                    fd = os.open(os.path.join(d, f), os.O_RDONLY)
                    held[fd] = os.pread(fd, 1000, 0)
        return files.scan_scripts(spark, root).select("path", "content")

    out = catalog._over_tree(spark, df, "reused", job)
    assert rows(out) == rows(df) and len(roots) == 10
    over = [os.pread(fd, 1000, 0) != was for fd, was in held.items()]
    for fd in held:
        os.close(fd)
    assert len(over) > 20 and sum(over) > len(over) / 2
    assert not [d for d in os.listdir(os.path.dirname(roots[0])) if d.startswith("reused") and "spare" in d]


def test_spare_files_in_use_are_not_written_over(spark, tmp_path):
    a, b, c, spare = (str(tmp_path / n) for n in ("a", "b", "c", "spare"))

    def frame(text, n):
        return spark.createDataFrame([(f"d/{i}.sql", text[:len(text) - i]) for i in range(n)], "path string, content string").coalesce(2)

    def want(text, n):
        return {f"d/{i}.sql": text[:len(text) - i] for i in range(n)}

    write_text_files(frame("a long text", 12), a, spare=spare)
    write_text_files(frame("other", 6), b, spare=spare)
    assert tree(a) == want("a long text", 12) and tree(b) == want("other", 6)
    write_text_files(frame("new", 4), a, spare=spare)  # over a tree that is there
    assert tree(a) == {**want("a long text", 12), **want("new", 4)} and tree(b) == want("other", 6)
    remove_text_files(frame("", 12), a)
    with pytest.raises(Exception, match="not a relative path"):
        write_text_files(frame("bad", 3).union(spark.createDataFrame([("../x", "bad")], "path string, content string")).coalesce(1), c, spare=spare)
    write_text_files(frame("last", 20), c, spare=spare)
    assert tree(c) == want("last", 20) and tree(b) == want("other", 6)
    remove_spare_files(spark, spare)
    assert not os.path.exists(spare) and tree(c) == want("last", 20)


@pytest.mark.parametrize("new", [True, False])
def test_files_are_moved_where_there_are_no_second_names(tmp_path, monkeypatch, new):
    def link(at, target):
        raise PermissionError(target)

    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("old")
    monkeypatch.setattr(os, "link", link)
    linked(str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "link"), new)
    assert tree(tmp_path) == {"b": "a"}


def test_a_chain_of_folders_is_listed_as_one_level(spark, tmp_path):
    root = str(tmp_path / "chain")
    want = [("one/two/three/x/1.sql", "1"), ("one/two/three/x/more/2.sql", "2"), ("one/two/three/y/3.sql", "3"), ("one/two/three/z.sql", "4")]
    write_text_files(spark.createDataFrame([*want, ("one/note.txt", "no script")], "path string, content string"), root)
    assert rows(files.list_paths(spark, root, ".sql")) == [(p,) for p, _ in want]
    assert {int(f.partition("/depth=")[2][0]) for f in files.list_paths(spark, root, ".sql").inputFiles()} == {0, 1, 2}
    assert rows(files.list_paths(spark, root, recursive=False)) == rows(files.list_paths(spark, root + "/one/two", ".none")) == []
