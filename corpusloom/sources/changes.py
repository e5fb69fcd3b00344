"""What changes in a source tree, as a stream: a row for each file that is new, changed or gone since the last look.

An offset is the number of a listing. Each look lists the tree and, where it differs from the last listing, keeps a new one in a log folder
that outlives the query; a batch is the difference of two listings, so a restarted query sees the batches it would have seen. The
tree and the log are folders that the driver and all executors mount; this is a source for trees that people work in, for the driver compares whole listings.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from corpusloom.sources.tree import FILES_PER_PARTITION, Files, walk


class ChangesReader(DataSourceStreamReader):
    def __init__(self, root: str, log: str, exclude: str):
        self.root, self.log, self.exclude = root, log, exclude
        os.makedirs(log, exist_ok=True)

    def _listing(self, number: int) -> dict[str, list[int]]:
        if not number:
            return {}
        with open(os.path.join(self.log, f"{number}.json"), encoding="utf-8") as f:
            return json.load(f)

    def _look(self) -> dict[str, list[int]]:
        found = {}
        for path in walk(self.root, self.exclude):
            try:
                s = os.stat(os.path.join(self.root, path))
            except OSError:  # gone meanwhile
                continue
            found[path] = [s.st_mtime_ns, s.st_size, s.st_ino]
        return found

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max((int(n[:-5]) for n in os.listdir(self.log) if n.endswith(".json")), default=0)
        now = self._look()
        if now != self._listing(last):
            last += 1
            own = os.path.join(self.log, f"{last}.{os.getpid()}.tmp")
            with open(own, "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.replace(own, os.path.join(self.log, f"{last}.json"))
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before, now = self._listing(start["listing"]), self._listing(end["listing"])
        paths = sorted({p for p in before.keys() | now.keys() if before.get(p) != now.get(p)})
        version = str(end["listing"])
        return [Files([version, *paths[i : i + FILES_PER_PARTITION]]) for i in range(0, len(paths), FILES_PER_PARTITION)] or [Files([version])]

    def read(self, partition: Files) -> Iterator[tuple[str, int, bytes | None]]:
        version, *paths = partition.paths
        for path in paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    yield path, int(version), f.read()
            except OSError:
                yield path, int(version), None

    def commit(self, end: dict) -> None:
        """Listings before the last one that is done are needed no more."""
        for name in os.listdir(self.log):
            if name.endswith(".json") and int(name[:-5]) < end["listing"] - 1:
                os.remove(os.path.join(self.log, name))


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree_changes"

    def schema(self) -> str:
        return "path string, version long, content binary"

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(self.options["path"], self.options["log"], self.options.get("exclude", "scan"))


def watch_tree(spark: SparkSession, root: str, log: str, exclude: str = "scan") -> DataFrame:
    """A stream of path, version, content; content is null where a file has gone."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("source_tree_changes").option("log", os.path.abspath(log)).option("exclude", exclude).load(os.path.abspath(root))
