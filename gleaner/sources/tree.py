"""Data source ``tree``: the files and directories below a root, listed by the executors.

    spark.dataSource.register(Tree)
    spark.read.format("tree").option("path", "/data").load()

One row for every entry: path, mtime, size, kind, reason. ``kind`` is ``file``,
``dir``, or ``skipped``, whose ``reason`` says why nothing below or in it is listed:
``dir:NAME`` (a pruned directory), ``symlink_dir``, ``unreadable_dir``, ``stat_failed``,
``not_regular_file``, ``bad_name`` (no Unicode), ``root_missing``. Names that begin
with a dot or an underscore are names like any other. Links to directories are
never followed, so no file comes twice and no loop is walked; a link to a file is
that file.

The driver looks for about ``subtrees`` directories, widest first, and lists no file:
each becomes a partition that an executor walks. A directory with more
children than that is dealt to several partitions by the hash of their names,
and each of these lists it; with the option ``later`` one partition lists it, once, and
gives its directories the kind ``open``: nothing below them is listed yet. ``tree``
exchanges these and has them walked.
Folders on disk are read by the operating system, other stores through pyarrow.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.functions import fixed

SCHEMA = "path string, mtime double, size long, kind string, reason string"
_ARROW = pa.schema([("path", pa.string()), ("mtime", pa.float64()), ("size", pa.int64()), ("kind", pa.string()), ("reason", pa.string())])
ROWS = 4096
#: path, mtime, size, kind, reason.
Row = tuple[str, float, int, str, str | None]


def clean(name: str) -> bool:
    """Whether a name is Unicode."""
    return not any("\ud800" <= c <= "\udfff" for c in name)


class Disk:
    """Folders that the operating system shows."""

    def entries(self, folder: str) -> Iterator[Row]:
        with os.scandir(folder) as found:
            for e in found:
                path = f"{folder.rstrip('/')}/{e.name}"
                if not clean(e.name):
                    yield path.encode("utf-8", "replace").decode(), 0.0, 0, "skipped", "bad_name"
                    continue
                try:
                    s = e.stat()
                except OSError:
                    yield path, 0.0, 0, "skipped", "stat_failed"
                    continue
                if stat.S_ISDIR(s.st_mode):
                    yield (path, 0.0, 0, "skipped", "symlink_dir") if e.is_symlink() else (path, 0.0, 0, "dir", None)
                elif stat.S_ISREG(s.st_mode):
                    yield path, s.st_mtime, s.st_size, "file", None
                else:
                    yield path, s.st_mtime, s.st_size, "skipped", "not_regular_file"

    def exists(self, folder: str) -> bool:
        return os.path.isdir(folder)


class Store:
    """A store that pyarrow reaches (hdfs, s3, gs); it shows no links."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, inner = fs.FileSystem.from_uri(root)
        self.prefix = root.rstrip("/").removesuffix(inner.rstrip("/"))

    def entries(self, folder: str) -> Iterator[Row]:
        from pyarrow import fs

        for e in self.fs.get_file_info(fs.FileSelector(folder.removeprefix(self.prefix), recursive=False)):
            path = self.prefix + e.path
            if e.type == fs.FileType.Directory:
                yield path, 0.0, 0, "dir", None
            elif e.type == fs.FileType.File:
                yield path, e.mtime_ns / 1e9 if e.mtime_ns else 0.0, e.size or 0, "file", None
            else:
                yield path, 0.0, 0, "skipped", "not_regular_file"

    def exists(self, folder: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(folder.removeprefix(self.prefix)).type == fs.FileType.Directory


def local(root: str) -> str | None:
    """The folder on disk that ``root`` names, if it does."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return root if root.startswith("/") else None if "://" in root else os.path.abspath(root)


class Part(InputPartition):
    """A directory: its own entries only (``later``: its directories are still to be walked), or (``deep``) all below those whose name's hash is ``slot`` of ``slots``."""

    def __init__(self, folder: str, deep: bool, slot: int = 0, slots: int = 1, later: bool = False):
        super().__init__(None)
        self.folder, self.deep, self.slot, self.slots, self.later = folder, deep, slot, slots, later


class TreeReader(DataSourceReader):
    def __init__(self, root: str, pruned: set[str], subtrees: int, later: bool = False):
        self.root, self.skip, self.subtrees, self.later = (local(root) or root).rstrip("/") or "/", pruned, subtrees, later

    def store(self) -> Disk | Store:
        return Disk() if local(self.root) else Store(self.root)

    def entries(self, store: Disk | Store, folder: str) -> Iterator[Row]:
        """The entries of a directory, pruned ones named so."""
        try:
            for row in store.entries(folder):
                name = row[0].rsplit("/", 1)[-1]
                yield (row[0], 0.0, 0, "skipped", f"dir:{name}") if row[3] == "dir" and name in self.skip else row
        except OSError:
            yield folder, 0.0, 0, "skipped", "unreadable_dir"

    def partitions(self) -> list[Part]:
        store, parts, deep = self.store(), [], deque([self.root])
        while deep and len(deep) + len(parts) < self.subtrees:
            folder = deep.popleft()
            room = self.subtrees - len(deep) - len(parts)
            inner = list(islice((r[0] for r in self.entries(store, folder) if r[3] == "dir"), room))
            if len(inner) == room and self.later:
                parts.append(Part(folder, False, later=True))
            elif len(inner) == room:  # so wide that its children are dealt by hash
                parts += [Part(folder, True, i, room) for i in range(room)]
            else:
                parts.append(Part(folder, False))
                deep.extend(inner)
        return parts + [Part(folder, True) for folder in deep]

    def rows(self, part: Part) -> Iterator[Row]:
        store = self.store()
        if part.folder == self.root and not store.exists(self.root):
            yield self.root, 0.0, 0, "skipped", "root_missing"
            return
        mine = lambda path: part.slots == 1 or zlib.crc32(path.encode()) % part.slots == part.slot
        below = []
        for row in self.entries(store, part.folder):
            if mine(row[0]):
                yield (*row[:3], "open", None) if part.later and row[3] == "dir" else row
                if part.deep and row[3] == "dir":
                    below.append(row[0])
        yield from self.below(store, below)

    def below(self, store: Disk | Store, below: list[str]) -> Iterator[Row]:
        """All that lies below these directories."""
        while below:
            for row in self.entries(store, below.pop()):
                yield row
                if row[3] == "dir":
                    below.append(row[0])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return batches(self.rows(partition))

    def walk(self, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as they are, and after each ``open`` directory all that lies below it."""
        store = self.store()

        def rows() -> Iterator[Row]:
            for batch in found:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[3] == "open":
                        yield (*row[:3], "dir", None)
                        yield from self.below(store, [row[0]])
                    else:
                        yield row

        return batches(rows())


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def batches(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, ROWS)):
        yield record_batch(part, _ARROW)


class Tree(DataSource):
    """Options: path; include_deps (prune dotted names only); prune (false: nothing is pruned); subtrees (256); later (false)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        deps, prune, later = (self.options.get(k, v).lower() == "true" for k, v in (("include_deps", "false"), ("prune", "true"), ("later", "false")))
        return TreeReader(self.options["path"], pruned_names(deps, prune), int(self.options.get("subtrees", "256")), later)


def pruned_names(include_deps: bool, prune: bool) -> set[str]:
    return {n for n in fixed.SKIP_DIRS if prune and (not include_deps or n.startswith("."))}


def tree(spark: SparkSession, root: str, include_deps: bool = False, prune: bool = True, subtrees: int = 256) -> DataFrame:
    """path, mtime, size, kind, reason of everything below ``root``; every directory is listed by one task, once."""
    spark.dataSource.register(Tree)
    reader = spark.read.format("tree").option("path", root).option("include_deps", str(include_deps)).option("prune", str(prune)).option("subtrees", subtrees)
    walker = TreeReader(root, pruned_names(include_deps, prune), subtrees)
    found = reader.option("later", "true").load().repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return found.mapInArrow(walker.walk, SCHEMA)
