"""A writer that puts each row's text into a file of its own, at its own path.

``df.write.format("text_files").mode("append").save(root)`` (after ``register``) takes
rows of ``path, content``.  A task writes its files into a hidden folder of its
own below ``root`` and, when all of them are complete, moves them to their
paths one by one; a move replaces the file that is there.  So no reader ever
sees a half file, a task that runs twice writes the same files, and a task that fails has
moved nothing.  Paths wait in a file beside the hidden ones, so that a task holds one row
and the folders it has made, however many files it writes.  The driver gets a count from each task, and removes
the hidden folder of the job at its end, whether it was committed or aborted.

Files are reached through ``pyarrow.fs`` (local and mounted paths, HDFS and
object stores).  Other files under ``root`` stay as they are.  A path is relative
to ``root`` and may not lead out of it; a null path fails the job before anything of its task
is moved; a null content is an empty file.  Paths must be unique.

Trees that come and go (option ``spare``, a folder beside ``root``) need not make and free
every file anew, which costs a file system more than writing them: there tasks keep a second name
of each file they write.  Once a tree's names are removed, a later job's tasks write over the
files that are left, folder by folder, if the task that left them was committed.  A file that another name leads to
is never written over, and the move is then a link.  Only local and mounted paths are written so.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import random
import shutil
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "text_files"
STAGING = "_staging-"
PATHS = "paths"           # a task's list of the paths it writes
LINK = "link"             # a second name of a file on its way to its path
FREE = "free"             # folders of spare files that a task may take
SPARE_FILES = 5_000       # files in one of them at most
KNOWN_FOLDERS = 100_000   # folders a task remembers to have made
REMOVING_TASKS = 1_000    # tasks over the folders of spare files


@dataclass
class Written(WriterCommitMessage):
    files: int
    folders: list[str]


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in root and root.startswith("file:"):
        root = root.removeprefix("file:")
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    return fs, path.rstrip("/")


def checked(path: str | None) -> str:
    """``path`` without needless parts; an error if it is not a file below the root."""
    if path is None:
        raise ValueError("a row without a path cannot be written")
    clean = posixpath.normpath(path)
    if not path or path.endswith("/") or clean in (".", "..") or clean.startswith(("/", "../")):
        raise ValueError(f"not a relative path of a file: {path!r}")
    return clean


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over, folders included."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Name and whether it is a folder of what ``folder`` holds, one by one and unopened."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                yield e.name, e.is_dir()
    else:
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            yield info.base_name, info.type == pafs.FileType.Directory


def spare_folders(pool: str) -> Iterator[str]:
    """Folders in ``pool`` for one task, one after another: such as committed tasks have left, then new ones."""
    os.makedirs(f"{pool}/{FREE}", exist_ok=True)
    names = os.listdir(f"{pool}/{FREE}")
    random.shuffle(names)
    while True:
        own = f"{pool}/{uuid.uuid4().hex}"
        while names:
            try:
                os.rename(f"{pool}/{FREE}/{names.pop()}", own)
                break
            except FileNotFoundError:
                pass  # another task has it
        else:
            os.mkdir(own)
        yield own


def opened(at: str) -> tuple[int, int]:
    """The file ``at`` to write to, and its size: a spare one that has no other name, else a new one."""
    try:
        fd = os.open(at, os.O_WRONLY | os.O_CLOEXEC)
    except FileNotFoundError:
        pass
    else:
        st = os.fstat(fd)
        if st.st_nlink == 1:
            return fd, st.st_size
        os.close(fd)
        os.unlink(at)
    return os.open(at, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_CLOEXEC, 0o666), 0


def put(at: str, content: bytes) -> None:
    """``content`` as the whole of the local file ``at``."""
    fd, size = opened(at)
    try:
        rest = memoryview(content)
        while rest:
            rest = rest[os.write(fd, rest):]
        if size > len(content) or not content:
            os.ftruncate(fd, len(content))
    finally:
        os.close(fd)


def linked(at: str, target: str, link: str, new: bool) -> bool:
    """Give ``at`` the second name ``target``, in place of the file that is there. ``new``: perhaps there is none; returned for the next one."""
    if new:
        try:
            os.link(at, target)
            return True
        except FileExistsError:
            pass
        except OSError:  # no second names here
            os.replace(at, target)
            return True
    try:
        os.link(at, link)
    except OSError:
        link = at
    os.replace(link, target)
    return False


class TextFilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, schema: StructType, spare: str | None = None):
        if missing := {"path", "content"} - set(schema.names):
            raise ValueError(f"missing columns {sorted(missing)}")
        self.root, self.job = root, STAGING + uuid.uuid4().hex
        self.pool = filesystem(spare)[1] if spare and isinstance(filesystem(root)[0], pafs.LocalFileSystem) else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.root)
        local = isinstance(fs, pafs.LocalFileSystem)
        if self.pool:
            new_folder, per = spare_folders(self.pool).__next__, SPARE_FILES
            folders = [new_folder()]
            fs.create_dir(root, recursive=True)
        else:
            folders, per = [f"{root}/{self.job}/{uuid.uuid4().hex}"], sys.maxsize
            fs.create_dir(folders[0], recursive=True)
        n, made, new = 0, {""}, True
        with fs.open_output_stream(f"{folders[0]}/{PATHS}", buffer_size=1 << 16) as paths:
            for b in iterator:
                for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    target, content = checked(path), (content or "").encode()
                    if n == per * len(folders):
                        folders.append(new_folder())
                    at = f"{folders[-1]}/{n % per}"
                    if local:
                        put(at, content)
                    else:
                        with fs.open_output_stream(at) as out:
                            out.write(content)
                    paths.write(json.dumps(target).encode() + b"\n")
                    n += 1
        with fs.open_input_stream(f"{folders[0]}/{PATHS}", buffer_size=1 << 16) as paths:
            for i, line in enumerate(io.TextIOWrapper(paths, "ascii")):
                target = json.loads(line)
                if (folder := posixpath.dirname(target)) not in made:
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    if len(made) >= KNOWN_FOLDERS:
                        made = {""}
                    made.add(folder)
                at = f"{folders[i // per]}/{i % per}"
                if self.pool:
                    new = linked(at, f"{root}/{target}", f"{folders[0]}/{LINK}", new)
                else:
                    (os.replace if local else fs.move)(at, f"{root}/{target}")
        return Written(n, folders)

    def _clean(self) -> None:
        fs, root = filesystem(self.root)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if not self.pool:
            return self._clean()
        for m in messages:  # what a task that failed or ran twice has left is not taken again, as it may still run
            for own in m.folders if m else ():
                os.rename(own, f"{self.pool}/{FREE}/{posixpath.basename(own)}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode('append')")
        return TextFilesWriter(self.options["path"], schema, self.options.get("spare"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFiles)


def write_text_files(df: DataFrame, root: str, path: str = "path", content: str = "content", spare: str | None = None) -> str:
    """Write each row of ``df`` as the file ``root/path``; ``spare``: the folder of spare files, if there are to be any."""
    register(df.sparkSession)
    out = df.selectExpr(f"CAST(`{path}` AS STRING) AS path", f"CAST(`{content}` AS STRING) AS content").write.format(FORMAT).mode("append")
    (out.option("spare", spare) if spare else out).save(root)
    return root


def _deleted(spark: SparkSession, root: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_text_files(df: DataFrame, root: str, path: str = "path") -> None:
    """Remove the files ``root/path`` of the rows of ``df`` in tasks, then ``root`` with what is left of it."""
    def run(batches):
        fs, base = filesystem(root)
        remove = os.unlink if isinstance(fs, pafs.LocalFileSystem) else fs.delete_file
        for b in batches:
            for p in b.column("path").to_pylist():
                try:
                    remove(f"{base}/{checked(p)}")
                except FileNotFoundError:
                    pass  # a path that comes twice, or a task that runs again
            yield b.slice(0, 0)

    df.selectExpr(f"CAST(`{path}` AS STRING) AS path").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    _deleted(df.sparkSession, root)


def remove_spare_files(spark: SparkSession, spare: str) -> None:
    """Remove a folder of spare files in tasks, each for one or more folders in it."""
    fs, pool = filesystem(spare)
    if not isinstance(fs, pafs.LocalFileSystem) or not os.path.isdir(f"{pool}/{FREE}"):
        return

    def run(batches):
        for b in batches:
            for at in b.column("at").to_pylist():
                shutil.rmtree(at, ignore_errors=True)
            yield b.slice(0, 0)

    at = [f"{d}/{name}" for d in (pool, f"{pool}/{FREE}") for name in os.listdir(d) if name != FREE]
    spark.createDataFrame([(x,) for x in at], "at string").repartition(min(max(len(at), 1), REMOVING_TASKS)).mapInArrow(run, "at string").write.format("noop").mode("overwrite").save()
    _deleted(spark, spare)
