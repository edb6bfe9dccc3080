"""Directories of text files and git logs as DataFrames."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.glob import IGNORED, TEXT_EXTENSIONS, extension, is_ignored, to_regex
from ..functions.text import make_id, windows
from ..operators.history import MARKER
from ..session import cut, ship

MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_FILES, MAX_TOTAL_BYTES = 100_000, 5 * 1024**3
SECTION_BYTES = 1024 * 1024
#: Fixed value: the note in a section that was cut.
SECTION_CUT = "\n... (commit section truncated due to size limit)\n"
#: Entries that a task lists before it hands the rest of its directories back, to be spread over all tasks.
LISTED = 20_000
#: Bytes of one task of a read, and of one batch that it gives.
TASK_BYTES, BATCH_BYTES = 128 << 20, 32 << 20

_LISTING = "path string, rel_path string, size_bytes long, mtime_ns long"


def allowed(path: str, roots: list[str]) -> bool:
    """Whether a real path lies in one of the roots; no roots allow nothing."""
    real = os.path.realpath(path)
    return any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _entries(system: pafs.FileSystem, path: str) -> list[tuple[str, bool, int, int]]:
    """(name, is a directory, bytes, mtime in ns) of a directory; links and what can't be read are left out."""
    out = []
    if isinstance(system, pafs.LocalFileSystem):
        try:
            with os.scandir(path) as found:
                for e in found:
                    try:
                        if not e.is_symlink() and (e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)):
                            s = e.stat(follow_symlinks=False)
                            out.append((e.name, e.is_dir(follow_symlinks=False), s.st_size, s.st_mtime_ns))
                    except OSError:
                        continue
        except OSError:
            return out
    else:
        try:
            for i in system.get_file_info(pafs.FileSelector(path)):
                out.append((i.base_name, i.type == pafs.FileType.Directory, i.size or 0, i.mtime_ns or 0))
        except OSError:
            return out
    return sorted(out)


def listing(spark: SparkSession, root: str, ignore=IGNORED) -> DataFrame:
    """(path, rel_path, size_bytes, mtime_ns) of every file below a root that isn't ignored, hidden ones included.

    Tasks list directories side by side; one that has met many entries hands its other directories back, so that
    a deep or wide part of the tree is spread over all tasks in the next round. Directories all of
    whose files are ignored aren't entered. Links and unreadable entries are skipped; a root that isn't there is empty.
    """
    ship(spark)
    base = root.rstrip("/") or "/"
    closed = re.compile("|".join(to_regex(p) for p in ignore if p.endswith("/**")) or r"(?!)")
    limit = LISTED

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(base)
        for b in batches:
            todo = b.column(0).to_pylist()[::-1]
            rows, met = [], 0
            while todo:
                rel = todo.pop()
                if met >= limit:
                    rows.append((None, rel, None, None))
                    continue
                for name, folder, size, mtime in _entries(system, f"{top}/{rel}" if rel else top):
                    met += 1
                    at = f"{rel}/{name}" if rel else name
                    if not folder:
                        rows.append((f"{top}/{at}", at, size, mtime))
                    elif not closed.match(at + "/"):
                        todo.append(at)
            c = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())], ["path", "rel_path", "size_bytes", "mtime_ns"])

    front = spark.createDataFrame([("",)], "rel string")
    found: DataFrame | None = None
    while True:
        step = cut(front.mapInArrow(walk, _LISTING))
        files = step.where("path is not null")
        found = files if found is None else found.unionByName(files)
        front = step.where("path is null").select(F.col("rel_path").alias("rel"))
        if front.isEmpty():
            break
        front = front.repartition(spark.sparkContext.defaultParallelism)
    return found.where(~is_ignored(F.col("rel_path"), ignore))


def _spread(files: DataFrame) -> DataFrame:
    """Rows of a listing over as many tasks as their bytes need."""
    total = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    return files.repartition(max(1, -(-total // TASK_BYTES)), F.xxhash64("rel_path"))


def _read(files: DataFrame, fields: list[pa.Field], schema: str, make) -> DataFrame:
    """The listing's columns and what `make` gives of each file's bytes; a file that can't be read, or changes meanwhile, gives no row."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held, kept = [], 0, []

            def flush():
                cols = list(zip(*rows)) if rows else [[]] * len(fields)
                return pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(kept, pa.int64())) for i in range(4)], *[pa.array(c, f.type) for c, f in zip(cols, fields)]], ["path", "rel_path", "size_bytes", "mtime_ns", *[f.name for f in fields]])

            for i, path in enumerate(b.column(0).to_pylist()):
                size, mtime = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                system, name = _open(path)
                try:
                    with system.open_input_stream(name) as f:
                        data = f.read()
                    now = system.get_file_info(name)
                except OSError:
                    continue
                if len(data) != size or now.size != size or (isinstance(system, pafs.LocalFileSystem) and os.stat(name).st_mtime_ns != mtime):
                    continue
                rows.append(make(data))
                kept.append(i)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield flush()
                    rows, held, kept = [], 0, []
            yield flush()

    return _spread(files.select("path", "rel_path", "size_bytes", "mtime_ns")).mapInArrow(run, f"{_LISTING}, {schema}")


def contents(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """A listing's files of at most `max_bytes` with their bytes in `content`."""
    return _read(files.where(F.col("size_bytes") <= max_bytes), [pa.field("content", pa.binary())], "content binary", lambda data: (data,))


def texts(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """A listing's files of at most `max_bytes` with content_hash, the sha256 of their bytes, and `text`, those bytes as UTF-8 without what isn't.

    One pass over the bytes, in the task that reads them; they don't travel further.
    """
    make = lambda data: (hashlib.sha256(data).hexdigest(), data.decode("utf-8", "ignore"))
    return _read(files.where(F.col("size_bytes") <= max_bytes), [pa.field("content_hash", pa.string()), pa.field("text", pa.string())], "content_hash string, text string", make)


def hashes(files: DataFrame) -> DataFrame:
    """A listing's files with content_hash, the sha256 of their bytes."""
    return _read(files, [pa.field("content_hash", pa.string())], "content_hash string", lambda data: (hashlib.sha256(data).hexdigest(),))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes (rel_path, content) rows as files below a root that all executors share, and gives each path's bytes; a row that repeats writes the same file."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(root.rstrip("/"))
        made = set()
        for b in batches:
            sizes = []
            for rel, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder = f"{top}/{rel}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{rel}") as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["rel_path", "size_bytes"])

    return rows.select("rel_path", "content").mapInArrow(run, "rel_path string, size_bytes long")


def scan(spark: SparkSession, root: str, ignore=IGNORED) -> DataFrame:
    """The listing of a root with each file's bytes in `content`, without files over the limit of a file."""
    return contents(listing(spark, root, ignore))


def supported(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> DataFrame:
    """Text files by extension and size."""
    return files.where(extension(F.col("rel_path")).isin(*extensions) & (F.col("size_bytes") <= max_bytes))


def ingest(files: DataFrame, target: int = 200, overlap: int = 30) -> DataFrame:
    """(chunk_id, rel_path, content_hash, chunk_index, token_range, content) of listed text files."""
    rows = texts(files).select("rel_path", "content_hash", make_id(F.col("path")).alias("base"), F.explode(windows(F.col("text"), target, overlap)).alias("w"))
    return rows.select(
        make_id(F.col("base"), F.col("w.chunk_index"), F.col("w.content")).alias("chunk_id"),
        "rel_path",
        "content_hash",
        F.col("w.chunk_index").alias("chunk_index"),
        F.concat_ws("-", F.col("w.first_token").cast("string"), F.col("w.last_token").cast("string")).alias("token_range"),
        F.col("w.content").alias("content"),
    )


def project_limits(files: DataFrame) -> DataFrame:
    """(files, bytes, within): what a project's files add up to, and whether that is allowed."""
    sums = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return sums.withColumn("within", (F.col("files") <= MAX_FILES) & (F.col("bytes") <= MAX_TOTAL_BYTES))


def cap_section(text: str, limit: int = SECTION_BYTES) -> str:
    """A section without the lines that would make it longer than `limit` bytes; a note stands where the first was left out."""
    out, size, noted = [], 0, False
    for line in text.splitlines(keepends=True):
        n = len(line.encode("utf-8", "surrogatepass"))
        if size + n <= limit:
            out.append(line)
            size += n
        elif not noted:
            out.append(SECTION_CUT)
            noted = True
    return "".join(out)


def capped(sections: DataFrame, limit: int = SECTION_BYTES) -> DataFrame:
    """(section) of at most `limit` bytes each, and a note; only those above it go through Python."""
    ship(sections.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([cap_section(t, limit) for t in b.column(0).to_pylist()], pa.string())], ["section"])

    rows = sections.select("section")
    long = F.octet_length("section") > limit
    return rows.where(~long).unionByName(rows.where(long).mapInArrow(run, "section string"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(section): the commit sections of saved `git log` output, split at the marker by the reader, each capped at 1 MiB."""
    rows = spark.read.option("lineSep", MARKER).text(path)
    return capped(rows.where(F.trim("value") != "").select(F.col("value").alias("section")))


def run_git_log(directory: str, to: str, limit: int = 500) -> str:
    """Saves the log of a repository's newest `limit` commits, merges left out, to the file `to` of any file system, in the form that `git_log` reads."""
    command = ["git", "-C", directory, "log", f"--max-count={limit}", "--no-merges", "--raw", "-p", f"--format={MARKER}%H|%an|%at|%s"]
    system, name = _open(to)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run, system.open_output_stream(name) as f:
        while block := run.stdout.read(1 << 20):
            f.write(block)
    if run.returncode:
        raise RuntimeError(f"git log of {directory} ended with {run.returncode}")
    return to
