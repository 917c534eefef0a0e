"""File-tree scans: file entries, whole-text scripts, descriptors.

``binaryFile`` (``scan_files``) reads ``content`` only when it is selected, a ``length``
filter is pushed into the scan, and names are filtered in the listing, so
files of other names or sizes are never opened. Paths are made relative to the scanned root, with ``/``.

It lists on the driver, which then holds every file and plans a task for each few dozen.
The scans that read whole contents (``scan_files_reported``, ``scan_scripts``,
``scan_descriptors``, ``scan_lines``) are for trees of many small files: tasks list the
folders, a level at a time, into a table of paths, and the tasks over that
table open the files. File systems that ``pyarrow.fs`` does not know are left to Spark's readers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, LongType, StringType, StructField, StructType,
                               TimestampType)

from strata.session import scratch_path
from strata.sources.text_files import entries, filesystem, hidden

OK, FAILED = "OK", "FAILED"
LISTED = 10_000         # paths in one file of a listing: what a task reads at least
LISTING_TASKS = 1_000   # tasks over the folders of one level
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20  # contents in one batch of a task, but for the last one
FILE_SCHEMA = StructType([
    StructField("path", StringType()), StructField("length", LongType()),
    StructField("mtime", TimestampType()), StructField("content", BinaryType())])


def _qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    """The file system's own form of ``root``, and whether it exists."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString().rstrip("/"), fs.exists(p)


def _name_glob(ext: str) -> str:
    """Names that end with ``ext`` in either case, as a listing filter."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.lower() != c.upper() else "\\" + c if c in "*?[]{}\\" else c for c in ext)


def _relative(root: str):
    # Listed paths are qualified like the root; what follows it is the relative path.
    one = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return F.substring(one(F.col("path")), F.length(one(F.lit(root))) + 2, F.length(F.col("path")))


def scan_files(spark: SparkSession, root: str, ext: str | None = None, recursive: bool = True,
               min_size: int = 1, missing: str = "error", layer: str | None = None,
               priority: int | None = None, any_case: bool = True, ignore_missing: bool = False) -> DataFrame:
    """Regular files under ``root`` whose name ends with ``ext`` (in either case
    if ``any_case``) and whose size is at least ``min_size`` (default: non-empty).

    ``missing``: ``"error"`` or ``"empty"`` when ``root`` does not exist.
    ``ignore_missing`` passes over files that are deleted after the listing.
    Optional ``layer``/``priority`` literals tag the tree as one layer.
    """
    full, exists = _qualified(spark, root)
    if not exists:
        if missing == "empty":
            df = spark.createDataFrame([], FILE_SCHEMA)
            return _tag(df, layer, priority)
        raise FileNotFoundError(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", str(ignore_missing).lower())
    if ext:
        reader = reader.option("pathGlobFilter", _name_glob(ext) if any_case else "*" + ext)
    df = reader.load(root).where(F.col("length") >= min_size)
    df = df.select(_relative(full).alias("path"), "length", F.col("modificationTime").alias("mtime"), "content")
    return _tag(df, layer, priority)


def _tag(df: DataFrame, layer, priority) -> DataFrame:
    if layer is not None:
        df = df.withColumn("layer", F.lit(layer))
    if priority is not None:
        df = df.withColumn("priority", F.lit(priority))
    return df


def _ends(name: str, ext: str, any_case: bool) -> bool:
    if name.endswith(ext):
        return True
    return any_case and len(name) >= len(ext) and all(c in (e.lower(), e.upper()) for c, e in zip(name[len(name) - len(ext):], ext, strict=True))


def _listable(full: str) -> bool:
    """Whether tasks can list ``full``: a folder of a file system that ``pyarrow.fs`` knows."""
    try:
        fs, base = filesystem(full)
        return fs.get_file_info(base or "/").type == pafs.FileType.Directory
    except (OSError, pa.ArrowException, ImportError):
        return False


def list_paths(spark: SparkSession, full: str, ext: str | None = None, recursive: bool = True, any_case: bool = True) -> DataFrame:
    """``path`` of every file below ``full`` that Spark's readers would list, taken down now
    (also of empty files, which they pass over; those who open them leave them out).

    Tasks list the folders of a level and write what they find, folders
    first to be listed next; the driver sees how many there are. A folder that is alone in its
    own is listed by the same task, so a chain of folders is one level. No file is opened."""
    def batch(paths, folders):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])

    def run(batches):
        fs, base = filesystem(full)
        for b in batches:
            for folder in b.column("path").to_pylist():
                while folder is not None:
                    paths, folders, more = [], [], False
                    for name, is_folder in entries(fs, f"{base}/{folder}" if folder else base or "/"):
                        if hidden(name) or not (is_folder if is_folder else not ext or _ends(name, ext, any_case)):
                            continue
                        paths.append(f"{folder}/{name}" if folder else name)
                        folders.append(is_folder)
                        if len(paths) == LISTED:
                            yield batch(paths, folders)
                            paths, folders, more = [], [], True
                    if recursive and folders == [True] and not more:
                        folder = paths[0]
                        continue
                    folder = None
                    yield batch(paths, folders)

    at = scratch_path(spark, "listing")
    level, n, depth = spark.range(1).select(F.lit("").alias("path")), 1, 0
    while n:
        out, seen = f"{at}/depth={depth}", Observation()
        level = level.repartition(min(n, LISTING_TASKS), "path") if n > 1 else level.coalesce(1)
        (level.mapInArrow(run, "path string, folder boolean").observe(seen, F.count_if("folder").alias("folders"))
         .write.option("maxRecordsPerFile", LISTED).partitionBy("folder").parquet(out))
        level, depth = spark.read.schema("path string, folder boolean").parquet(out).where("folder").select("path"), depth + 1
        n = seen.get["folders"] if recursive else 0
    return spark.read.schema("path string, depth int, folder boolean").parquet(at).where("NOT folder").select("path")


def _contents(fs: pafs.FileSystem, path: str) -> tuple[int, int, Callable[[], bytes]]:
    """Size, time of change in microseconds, and what reads the file's bytes."""
    if isinstance(fs, pafs.LocalFileSystem):
        st = os.stat(path)

        def read() -> bytes:
            with open(path, "rb", 0) as f:
                return f.readall()
        return st.st_size, st.st_mtime_ns // 1_000_000 * 1000, read
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)

    def read_stream() -> bytes:
        with fs.open_input_stream(path) as f:
            return f.read()
    return info.size, (info.mtime_ns or 0) // 1_000_000 * 1000, read_stream


def _mapped(paths: DataFrame, full: str, schema: pa.Schema, of_file: Callable[[pafs.FileSystem, str, str], Iterator[tuple]], ddl: str) -> DataFrame:
    """The rows that ``of_file`` (file system, where it is, relative path) gives for each
    path; a task holds the rows of ``BATCH_ROWS`` or about ``BATCH_BYTES`` at a time, and one file."""
    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        fs, base = filesystem(full)
        held, size = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                for row in of_file(fs, f"{base}/{path}", path):
                    more = sum(len(v) for v in row if isinstance(v, bytes))
                    if held and (len(held) == BATCH_ROWS or size + more > BATCH_BYTES):
                        yield batch(held)
                        held, size = [], 0
                    held.append(row)
                    size += more
        if held:
            yield batch(held)

    return paths.mapInArrow(run, ddl)


def _whole(spark: SparkSession, root: str, ext: str, recursive: bool, min_size: int, missing: str, any_case: bool) -> DataFrame:
    """``path, content`` of the files that ``scan_files`` gives."""
    full, exists = _qualified(spark, root)
    if not exists or not _listable(full):
        return scan_files(spark, root, ext, recursive, min_size, missing, any_case=any_case).select("path", "content")

    def of_file(fs, at, path):
        size, _, read = _contents(fs, at)
        if size >= max(min_size, 1):
            yield path, read()

    return _mapped(list_paths(spark, full, ext, recursive, any_case), full, pa.schema([("path", pa.string()), ("content", pa.binary())]),
                   of_file, "path string, content binary")


def scan_files_reported(spark: SparkSession, root: str, ext: str | None = None, recursive: bool = True, min_size: int = 1,
                        missing: str = "error", max_size: int = 1 << 30) -> DataFrame:
    """``scan_files`` that outlives files it cannot read: every listed file (but for
    those deleted before they are reached) is a row with ``status`` OK or FAILED and the ``reason``; a failed one has null
    content. The listing opens no file; tasks then read each on its own (a
    file beyond ``max_size`` bytes is reported, not read)."""
    ddl = "path string, length long, mtime timestamp, content binary, status string, reason string"
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.binary()),
                        ("status", pa.string()), ("reason", pa.string())])
    full, exists = _qualified(spark, root)

    def of_file(fs, at, path):
        try:
            size, mtime, read = _contents(fs, at)
        except FileNotFoundError:
            return
        except (OSError, pa.ArrowException) as e:
            yield path, None, None, None, FAILED, f"{type(e).__name__}: {e}"
            return
        if size < max(min_size, 1):
            return
        try:
            if size > max_size:
                raise OSError(f"larger than {max_size} bytes")
            got = read(), OK, None
        except (OSError, pa.ArrowException) as e:
            got = None, FAILED, f"{type(e).__name__}: {e}"
        yield path, size, mtime, *got

    if exists and _listable(full):
        paths = list_paths(spark, full, ext, recursive)
    else:
        paths = scan_files(spark, root, ext, recursive, min_size, missing, ignore_missing=True).select("path")
    return _mapped(paths, full, schema, of_file, ddl)


def scan_lines(spark: SparkSession, root: str, ext: str | None = None, any_case: bool = True) -> DataFrame:
    """``path, block, at, line``: the lines of every file, for files of any size.

    A file beyond ``spark.sql.files.maxPartitionBytes`` is split like any other text, so no row holds more than a line;
    smaller ones are read whole, many to a task.
    ``(block, at)`` order the lines of a file: where their split begins in it, and the
    reader's order within the split. Empty files have no lines.
    """
    full, exists = _qualified(spark, root)
    if not exists or not _listable(full):
        return _split_lines(spark, full, [root], ext, any_case)
    limit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    paths = list_paths(spark, full, ext, any_case=any_case)

    def long(fs, at, path):
        if _contents(fs, at)[0] > limit:
            yield path,

    def of_file(fs, at, path):
        size, _, read = _contents(fs, at)
        name = _quoted(path)
        if size <= limit:
            # as Spark's reader cuts lines: at \n, \r or both, a byte-order mark left out
            for i, line in enumerate(read().removeprefix(b"\xef\xbb\xbf").splitlines()):
                yield name, 0, i, line

    lines = _mapped(paths, full, pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("line", pa.binary())]), of_file,
                    "path string, block long, at long, line binary").withColumn("line", F.col("line").cast("string"))
    large = [r["path"] for r in _mapped(paths, full, pa.schema([("path", pa.string())]), long, "path string").collect()]  # at most one a split of the input
    return lines.unionByName(_split_lines(spark, full, [f"{full}/{_escaped(p)}" for p in large])) if large else lines


# what ``_metadata.file_path`` quotes: all of ASCII but these, and spaces and controls beyond it
_QUOTED = re.compile(r"[^\w\-!.~'()*,;:$&+=@/\x80-\U0010ffff]|[\x80-\x9f\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _quoted(path: str) -> str:
    """``path`` as ``_metadata.file_path`` has it."""
    return _QUOTED.sub(lambda m: quote(m[0], safe=""), path)


def _escaped(path: str) -> str:
    """``path`` as a pattern that matches it alone."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def _split_lines(spark: SparkSession, full: str, roots: list[str], ext: str | None = None, any_case: bool = True) -> DataFrame:
    reader = spark.read.format("text").option("recursiveFileLookup", "true")
    if ext:
        reader = reader.option("pathGlobFilter", _name_glob(ext) if any_case else "*" + ext)
    df = reader.load(roots).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return df.select(_relative(full).alias("path"), "block", F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def last_lines(lines: DataFrame) -> DataFrame:
    """``path, last_line, n_lines`` of each file of ``scan_lines``; one partial aggregate."""
    return lines.groupBy("path").agg(F.max_by("line", F.struct("block", "at")).alias("last_line"), F.count(F.lit(1)).alias("n_lines"))


def _text():
    return F.make_valid_utf8(F.col("content").cast("string"))


def scan_scripts(spark: SparkSession, root: str, ext: str = ".sql", missing: str = "error") -> DataFrame:
    """``(path, content)``: each non-empty script as one UTF-8 string; bytes that
    are not UTF-8 become U+FFFD."""
    return _whole(spark, root, ext, True, 1, missing, True).select("path", _text().alias("content"))


def scan_descriptors(spark: SparkSession, root: str, missing: str = "empty") -> DataFrame:
    """``(path, xml)`` for ``*.xml`` directly in ``root`` (not recursive, case-sensitive
    extension); a missing folder gives an empty result."""
    return _whole(spark, root, ".xml", False, 0, missing, False).select("path", _text().alias("xml"))
