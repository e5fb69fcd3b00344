"""Source trees as rows: path (below the root), length and content of each file.

The built-in file source hides names that begin with a dot or an underscore, which source trees need,
so folders are listed here. Listing is work of tasks: each takes folders and lists what is below them, up to LISTED names, and hands on the
folders that it has not come to as the next round's rows; the files that it found leave it in packs of PACK_BYTES. So the driver
never holds a path, a deep or lopsided tree is spread, and a task reads about as many bytes as any other.

The data source ``source_tree`` reads a small tree by one listing on the driver. ``exclude="scan"`` leaves out what the line scan skips,
``exclude="deep"`` what the deep analysis skips. A root that is a file is read whatever its name.
The root must be a folder that all executors mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.sources.shared import stored

# What the line scan leaves out.
SKIPPED_FOLDERS = [".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".tox", ".eggs", "build", "dist", ".mypy_cache", ".pytest_cache", ".next", ".nuxt", ".cache", "target", ".gradle", ".idea", ".vscode", "bower_components", ".serverless", ".terraform"]
SKIPPED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "Cargo.lock", "go.sum", "composer.lock"]
SKIPPED_ENDINGS = [".pyc", ".pyo", ".so", ".dll", ".exe", ".bin", ".dat", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".mp4", ".mp3", ".wav", ".avi", ".mov", ".zip", ".tar", ".gz", ".bz2", ".7z", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".ttf", ".otf", ".woff", ".woff2", ".min.js", ".min.css"]
MAX_BYTES = 5 * 1024 * 1024
# What the deep analysis leaves out.
SKIPPED_DEEP_FOLDERS = [".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist", ".mypy_cache", ".pytest_cache"]
#: Files that one partition reads, at most.
FILES_PER_PARTITION = 200
#: Names that a task lists in a round, and bytes and files of a pack, about.
LISTED, PACK_BYTES, PACK_FILES = 20_000, 32 << 20, 2_000
#: Bytes of contents that leave a task at once, about.
BATCH_BYTES = 4 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


def skipped(name: str, size: int, exclude: str) -> bool:
    return exclude == "scan" and (name in SKIPPED_NAMES or name.lower().endswith(tuple(SKIPPED_ENDINGS)) or size > MAX_BYTES)


def list_folder(root: str, folder: str, exclude: str) -> tuple[list[str], list[tuple[str, int]]]:
    """The folders below a folder, and its files with their sizes, by their paths below the root; what can't be listed is empty."""
    without = {"scan": SKIPPED_FOLDERS, "deep": SKIPPED_DEEP_FOLDERS, "none": []}[exclude]
    folders, files = [], []
    try:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return [], []
    for e in entries:
        path = os.path.join(folder, e.name)
        try:
            if e.is_dir():
                if not e.is_symlink() and e.name not in without:
                    folders.append(path)
            elif not skipped(e.name, size := e.stat().st_size, exclude):
                files.append((path, size))
        except OSError:
            if exclude != "scan":
                files.append((path, 0))
    return folders, files


def walk(root: str, exclude: str) -> Iterator[str]:
    """Paths below the root, folder by folder."""
    ahead = [""]
    while ahead:
        folders, files = list_folder(root, ahead.pop(), exclude)
        yield from (path for path, _ in files)
        ahead.extend(reversed(folders))


_LISTED = pa.schema([("folder", pa.string()), ("paths", pa.list_(pa.string())), ("bytes", pa.int64())])


def list_tree(spark: SparkSession, root: str, exclude: str = "scan") -> DataFrame:
    """paths, bytes: the files of a tree in packs, listed by tasks."""
    wide = spark.sparkContext.defaultParallelism

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = [x for batch in batches for x in batch.column(0).to_pylist()]
        seen, pack, size = 0, [], 0
        while ahead and seen < LISTED:
            folders, files = list_folder(root, ahead.pop(0), exclude)
            seen += len(folders) + len(files) + 1
            ahead.extend(folders)
            for path, n in files:
                pack.append(path)
                size += n
                if size >= PACK_BYTES or len(pack) >= PACK_FILES:
                    yield pa.RecordBatch.from_pylist([{"paths": pack, "bytes": size}], _LISTED)
                    pack, size = [], 0
        rows = [{"folder": x} for x in ahead] + ([{"paths": pack, "bytes": size}] if pack else [])
        yield pa.RecordBatch.from_pylist(rows, _LISTED)

    folders, found = spark.createDataFrame([("",)], "folder string"), []
    while True:
        done = stored(folders.mapInArrow(listing, "folder string, paths array<string>, bytes long"), "listed")
        found.append(done.where("paths is not null").select("paths", "bytes"))
        folders = done.where("folder is not null").select("folder")
        left = folders.count()
        if not left:
            return reduce(DataFrame.union, found)
        folders = folders.repartition(max(1, min(left, 4 * wide)))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, exclude: str):
        self.root, self.exclude = root, exclude

    def partitions(self) -> list[Files]:
        paths = [""] if os.path.isfile(self.root) else list(walk(self.root, self.exclude))
        return [Files(paths[i : i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, int, bytes | None]]:
        for path in partition.paths:
            at = os.path.join(self.root, path) if path else self.root
            try:
                with open(at, "rb") as f:
                    raw = f.read()
            except OSError:
                yield path or os.path.basename(at), 0, None
                continue
            yield path or os.path.basename(at), len(raw), raw


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("exclude", "scan"))


def read_tree(spark: SparkSession, root: str, exclude: str = "scan") -> DataFrame:
    """path, length, content of the files of a tree; content is null where a file can't be read."""
    root = os.path.abspath(root)
    if os.path.isfile(root):
        spark.dataSource.register(SourceTree)
        return spark.read.format("source_tree").option("exclude", exclude).load(root)
    packs = list_tree(spark, root, exclude)
    kinds = [pa.string(), pa.int64(), pa.binary()]

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "length", "content"])
        for row in TreeReader(root, exclude).read(Files([p for batch in batches for paths in batch.column(0).to_pylist() for p in paths])):
            rows.append(row)
            size += row[1]
            if size >= BATCH_BYTES or len(rows) >= PACK_FILES:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    # a pack is a task's work: as many partitions as packs
    n = packs.agg(F.count("*")).first()[0]
    return packs.select("paths").repartition(max(1, n)).mapInArrow(reading, "path string, length long, content binary")
