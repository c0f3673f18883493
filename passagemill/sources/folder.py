"""Folders as a data source: batch and streaming listings over any file system that Arrow opens.

``spark.read.format("passage_folder")`` lists a folder; ``spark.readStream`` gives the files that are
new or have changed since the offset before.  No file is opened by either.

A batch looks at folders until there are enough to share out; the rest are walked in tasks, one
partition each.  A stream's offset names a snapshot of the listing, a Parquet file of paths,
sizes and times under ``snapshots``; the files of a micro-batch are the difference of two
snapshots, dealt to partitions by their bytes, so a batch that is run again sees the same files.
While nothing changes the offset stays what it is and no micro-batch runs.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from passagemill.schemas import MIMES

FORMAT = "passage_folder"
#: Folders that a batch lists before it shares out the rest; bytes of files and files of a stream's partition.
SPREAD_FOLDERS, PARTITION_BYTES, PARTITION_FILES = 64, 64 << 20, 1000


@dataclass(frozen=True)
class Entry:
    """A candidate file; ``real`` opens it, ``mtime`` in microseconds, ``reason`` why it cannot be taken."""

    path: str
    real: str
    doc_id: str
    filename: str
    suffix: str
    size: int
    mtime: int
    reason: str | None


SCHEMA = "path string, real string, doc_id string, filename string, suffix string, size bigint, mtime bigint, reason string"
_ARROW = pa.schema([(c.split()[0], pa.int64() if "bigint" in c else pa.string()) for c in SCHEMA.split(", ")])


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" not in path:
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(path)


class Tree:
    """A folder to list: what lies in it, which files are candidates, what leads out of it."""

    def __init__(self, fs: arrow_fs.FileSystem, root: str, skip: str = "", uri: str = ""):
        self.fs, self.local = fs, isinstance(fs, arrow_fs.LocalFileSystem)
        self.root = os.path.realpath(root) if self.local else root.rstrip("/")
        self.skip = os.path.realpath(skip) if skip and self.local else skip.rstrip("/")
        # What makes a URI of a path of this file system; nothing for a local one.
        self.before, _, self.after = ("", "", "") if self.local else uri.partition(root)

    def children(self, folder: str) -> tuple[list[str], list[Entry]]:
        """Sub-folders and candidate files; an unreadable folder raises."""
        folders, files = [], []
        if self.local:
            with os.scandir(folder) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(entry.path)
                    elif found := self.entry(entry.path):
                        files.append(found)
        else:
            for info in self.fs.get_file_info(arrow_fs.FileSelector(folder)):
                if info.type == arrow_fs.FileType.Directory:
                    folders.append(info.path)
                elif found := self.entry(info.path, info):
                    files.append(found)
        return folders, files

    def entry(self, path: str, info: arrow_fs.FileInfo | None = None) -> Entry | None:
        """The candidate at a path, or None when it is not one."""
        name = os.path.basename(path)
        suffix = os.path.splitext(name)[1].lower()
        if name.startswith(".") or suffix not in MIMES:
            return None
        if not self.local:
            return self._within(path, path, suffix, info.size or 0, int(info.mtime_ns or 0) // 1000)
        if not os.path.isfile(path):
            return None
        try:
            real = os.path.realpath(path, strict=True)
            stat = os.stat(real)
        except OSError:
            return Entry(path, "", "", name, suffix, 0, 0, "unreadable file")
        return self._within(path, real, suffix, stat.st_size, stat.st_mtime_ns // 1000)

    def _within(self, path: str, real: str, suffix: str, size: int, mtime: int) -> Entry | None:
        if self.skip and Path(real).is_relative_to(self.skip):
            return None
        name, source = os.path.basename(real), f"{self.before}{real}{self.after}"
        if not Path(real).is_relative_to(self.root):
            return Entry(path, source, "", name, suffix, size, mtime, "leads out of the folder")
        return Entry(path, source, Path(real).relative_to(self.root).as_posix(), name, suffix, size, mtime, None)

    def walk(self, folder: str) -> Iterator[Entry]:
        folders, files = self.children(folder)
        yield from files
        for deeper in folders:
            yield from self.walk(deeper)


@dataclass
class Files(InputPartition):
    entries: list[Entry]


@dataclass
class Folder(InputPartition):
    path: str


def by_bytes(entries: list[Entry], most: int = PARTITION_BYTES, files: int = PARTITION_FILES) -> list[Files]:
    """Partitions of about equal bytes, in path order."""
    parts: list[Files] = []
    held = most
    for entry in sorted(entries, key=lambda e: e.path):
        if held + entry.size > most or len(parts[-1].entries) >= files:
            parts.append(Files([]))
            held = 0
        parts[-1].entries.append(entry)
        held += entry.size
    return parts


class FolderSource(DataSource):
    """Options: ``path``, ``skip`` (a folder that is left out), ``snapshots`` (streams: where listings are kept)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def tree(self) -> tuple[Tree, str]:
        fs, path = opened(self.options["path"])
        skip = self.options.get("skip", "")
        tree = Tree(fs, path, opened(skip)[1] if skip else "", self.options["path"])
        return tree, (path if tree.local else tree.root)

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(*self.tree())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(*self.tree(), self.options["snapshots"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


def _rows(entries: list[Entry]) -> Iterator[pa.RecordBatch]:
    if entries:
        yield pa.RecordBatch.from_pylist([asdict(e) for e in entries], schema=_ARROW)


class FolderReader(DataSourceReader):
    def __init__(self, tree: Tree, path: str):
        self.tree, self.path = tree, path

    def partitions(self) -> list[InputPartition]:
        found: list[Entry] = []
        folders = [self.path]
        while folders and len(folders) < SPREAD_FOLDERS:
            deeper = []
            for folder in folders:
                inner, files = self.tree.children(folder)
                deeper += inner
                found += files
            folders = deeper
        return [*by_bytes(found, files=100_000), *map(Folder, folders)] or [Files([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Files):
            yield from _rows(partition.entries)
        else:
            held = []
            for entry in self.tree.walk(partition.path):
                held.append(entry)
                if len(held) == PARTITION_FILES:
                    yield from _rows(held)
                    held = []
            yield from _rows(held)


class FolderStream(DataSourceStreamReader):
    def __init__(self, tree: Tree, path: str, snapshots: str, partition_bytes: int):
        self.tree, self.path, self.snapshots, self.partition_bytes = tree, path, snapshots, partition_bytes

    def _file(self, name: str) -> tuple[arrow_fs.FileSystem, str]:
        fs, folder = opened(self.snapshots)
        return fs, f"{folder.rstrip('/')}/{name}.parquet"

    def _load(self, offset: dict) -> dict[str, Entry]:
        if not offset["files"]:
            return {}
        fs, file = self._file(offset["listing"])
        return {r["path"]: Entry(**r) for r in pq.read_table(file, filesystem=fs).to_pylist()}

    def initialOffset(self) -> dict:
        return {"listing": "", "files": 0}

    def _names(self) -> list[str]:
        fs, file = self._file("")
        found = fs.get_file_info(arrow_fs.FileSelector(os.path.dirname(file), allow_not_found=True))
        return sorted(os.path.basename(i.path).removesuffix(".parquet") for i in found if i.path.endswith(".parquet"))

    def latestOffset(self) -> dict:
        entries = sorted(self.tree.walk(self.path), key=lambda e: e.path)
        if not entries:
            return self.initialOffset()
        seal = hashlib.sha256()
        for e in entries:
            seal.update(f"{e.path}\0{e.real}\0{e.size}\0{e.mtime}\0{e.reason}\0".encode("utf-8", "surrogateescape"))
        seal, names = seal.hexdigest()[:32], self._names()
        if names and names[-1].endswith(seal):
            return {"listing": names[-1], "files": len(entries)}
        name = f"{time.time_ns():020d}-{seal}"
        fs, file = self._file(name)
        fs.create_dir(os.path.dirname(file), recursive=True)
        # Written aside and moved, so that a snapshot is whole or not there.
        pq.write_table(pa.Table.from_pylist([asdict(e) for e in entries], schema=_ARROW), f"{file}.part", filesystem=fs)
        fs.move(f"{file}.part", file)
        return {"listing": name, "files": len(entries)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = self._load(start)
        changed = [e for path, e in self._load(end).items() if before.get(path) != e]
        return by_bytes(changed, self.partition_bytes) or [Files([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition.entries)

    def commit(self, end: dict) -> None:
        """Snapshots older than the committed one are not asked for again."""
        for name in self._names():
            if name < end["listing"]:
                fs, file = self._file(name)
                fs.delete_file(file)
