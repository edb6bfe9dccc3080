"""Tables in versions, each named by one atomic rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Versions kept for readers that began before the newest, and folders of a part beyond which it is written anew.
KEEP, COMPACT = 8, 24


class Conflict(RuntimeError):
    """What was read has been replaced by another writer meanwhile."""


class VersionedTable:
    """A Parquet table in a folder of any Hadoop file system whose rename is atomic.

    A version is a list of (part, folder), written to a pointer file `current-N` that a rename creates once:
    readers see the old version or the new one, and of two writers one fails. Parts, such as projects, are replaced or
    appended to on their own: a writer that loses the race against one of another part takes the newest
    version as its base and tries again; against one of its own part, a replacement is a Conflict, and an
    append goes behind it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._schemas: dict[str, object] = {}  # of the folders written here, which needn't be asked for it
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n[8:]) for n in names if n.startswith("current-") and n[8:].isdigit())

    def version(self) -> int:
        """The newest version, 0 before the first."""
        found = self.versions()
        return found[-1] if found else 0

    def entries(self, version: int) -> list[tuple[str, str]]:
        """(part, folder) of a version."""
        if not version:
            return []
        stream = self._fs.open(self._file(f"current-{version}"))
        try:
            lines = bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()
        return [(part, name) for part, _, name in (x.rpartition("\t") for x in lines if x)]

    def load(self, version: int | None = None, part: str | None = None) -> DataFrame | None:
        """The newest version, or the one asked for, whole or a part of it; None where nothing was written yet."""
        found = self.entries(self.version() if version is None else version)
        paths = [f"{self.path}/{name}" for p, name in found if part is None or p == part]
        if not paths:
            return None
        known = [self._schemas.get(name) for p, name in found if part is None or p == part]
        same = known[0] is not None and all(k == known[0] for k in known)
        return (self.spark.read.schema(known[0]) if same else self.spark.read).parquet(*paths)

    def _stage(self, df: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self._schemas[name] = df.schema
        return name

    def _point(self, entries: list[tuple[str, str]], version: int) -> bool:
        """Publishes a version; false if it is taken."""
        temp, target = self._file(f".pointer-{uuid.uuid4().hex}"), self._file(f"current-{version}")
        out = self._fs.create(temp, True)
        out.write(bytearray("\n".join(f"{p}\t{n}" for p, n in entries).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(temp, target):
            self._fs.delete(temp, False)
            return False
        return True

    def publish(self, df: DataFrame, expected: int | None = None) -> int:
        """Writes `df` as the whole version after `expected` (by default the newest); a Conflict if that one is taken by then."""
        expected = self.version() if expected is None else expected
        if not self._point([("", self._stage(df))], expected + 1):
            raise Conflict(f"version {expected + 1} was published by another run")
        return expected + 1

    def replace(self, part: str, df: DataFrame | None, expected: int) -> int:
        """Writes `df` in the place of all rows of a part as they were in version `expected`; None removes them."""
        was = [e for e in self.entries(expected) if e[0] == part]
        name = None if df is None else self._stage(df)
        while True:
            at = self.version()
            now = self.entries(at)
            if [e for e in now if e[0] == part] != was:
                raise Conflict(f"{part} was written by another run since version {expected}")
            if self._point([e for e in now if e[0] != part] + ([(part, name)] if name else []), at + 1):
                self.prune(KEEP)
                return at + 1

    def append(self, part: str, df: DataFrame) -> int:
        """Adds rows to a part, behind what other writers added; a part of many folders is then written anew."""
        name = self._stage(df)
        while True:
            at = self.version()
            now = self.entries(at) + [(part, name)]
            if self._point(now, at + 1):
                break
        if sum(p == part for p, _ in now) > COMPACT:
            try:
                return self.replace(part, self.load(at + 1, part), at + 1)
            except Conflict:
                return at + 1  # the next append does it
        self.prune(KEEP)
        return at + 1

    def change(self, part: str, make: Callable[[DataFrame | None], DataFrame | None], tries: int = 8) -> int:
        """Replaces a part by what `make` gives of its rows (None: there are none), anew where another writer came between."""
        for n in range(tries):
            at = self.version()
            try:
                return self.replace(part, make(self.load(at, part)), at)
            except Conflict:
                if n == tries - 1:
                    raise
        raise AssertionError

    def prune(self, keep: int = 1) -> None:
        """Removes all but the newest `keep` versions, pointers first, and the folders that no version left names."""
        found = self.versions()
        old = found[:-keep]
        if not old:
            return
        gone = {name for v in old for _, name in self.entries(v)}
        held = reduce(set.union, ({name for _, name in self.entries(v)} for v in found[-keep:]), set())
        for version in old:
            self._fs.delete(self._file(f"current-{version}"), False)
        for name in gone - held:
            self._fs.delete(self._file(name), True)

    def drop(self) -> None:
        """Removes the table with all its versions."""
        self._fs.delete(self._root, True)
