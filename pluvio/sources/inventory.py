"""Inventory of recordings as a data source: a folder walk that is split over tasks.

Unlike Spark's own file sources it also lists names that start with `_` or `.` and files of zero bytes. Folders whose
names start with `.` are left out. Any file system that pyarrow knows can be walked; paths have the form that Spark gives them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_name string, file_path string, extension string, location string, bytes long"
# Folders listed on the driver to find as many to share out; below them every task walks its own.
PLANNED_FOLDERS = 256


def open_path(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, place in it, and what stands before places in Spark's form of a path."""
    if "://" in path and not path.startswith("file:"):
        system, place = fs.FileSystem.from_uri(path)
        bare = place.rstrip("/")
        return system, place, path[:path.rindex(bare)] if bare else path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^(file:)?/+", "/", path)), "file:"


def read_file(path: str) -> bytes:
    """Content of one file, read where this runs; a missing file raises FileNotFoundError."""
    system, place, _ = open_path(path)
    with system.open_input_stream(place) as stream:
        return stream.read()


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, int | None]]:
    """(name, place, bytes) of the folders and files directly below a folder; a folder has None for bytes.

    Local folders are read as they go, since one may hold any number of files.
    """
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_dir():
                        yield e.name, e.path, None
                    elif e.is_file():
                        yield e.name, e.path, e.stat().st_size
                except FileNotFoundError:  # gone since it was listed
                    continue
        return
    for e in system.get_file_info(fs.FileSelector(folder)):
        if e.type in (fs.FileType.Directory, fs.FileType.File):
            yield e.base_name, e.path, e.size if e.type == fs.FileType.File else None


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with all folders below it

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class InventoryReader(DataSourceReader):
    def __init__(self, root: str, extensions: tuple[str, ...], location: str | None):
        self.root, self.extensions = root, extensions
        self.location = location if location is not None else root.rstrip("/").rsplit("/", 1)[-1]

    def _listed(self, system: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, int | None]]:
        """(name, place, bytes) of the folders, which have None for bytes, and the wanted files directly below a folder."""
        for name, place, size in _entries(system, folder):
            if not name.startswith(".") if size is None else name.lower().endswith(self.extensions):
                yield name, place, size

    def partitions(self) -> list[Folder]:
        system, top, _ = open_path(self.root)
        plan, waiting = [], [top]
        while waiting and len(plan) + len(waiting) < PLANNED_FOLDERS:
            folder = waiting.pop(0)
            plan.append(Folder(folder, False))
            waiting += [place for _, place, size in self._listed(system, folder) if size is None]
        return plan + [Folder(folder, True) for folder in waiting]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, _, before = open_path(self.root)
        waiting = [partition.path]
        while waiting:
            for name, place, size in self._listed(system, waiting.pop()):
                if size is None:
                    if partition.deep:
                        waiting.append(place)
                    continue
                suffix = re.search(r"\.[^.]+$", name)
                yield name, before + place, suffix[0].lower() if suffix else "", self.location, size


class RecordingInventory(DataSource):
    """Format `recordings`: option `extensions` (joined by commas), option `location`; the loaded path is the root folder."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        wanted = tuple(e.strip().lower() for e in self.options.get("extensions", ".wav").split(","))
        return InventoryReader(self.options["path"], wanted, self.options.get("location"))
