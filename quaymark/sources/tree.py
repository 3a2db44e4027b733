"""A source tree as a Spark data source: a row for each file, and for what is passed over and why.

Folders are dealt over tasks, which walk them and read each file once. Links are rows and are never followed;
pruned and excluded folders are rows and are not entered. The tree must be readable under the same path by
all executors; trees in other stores are read by ``files.read_tree``.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quaymark.sources.files import MAX_BYTES, PRUNED

ENTRY = "path string, kind string, length bigint, sha256 string, text string"
#: Folders to which a task is sent are at most this deep.
DEEP = 2


@dataclass
class Folder(InputPartition):
    """A folder below the root, and whether a task goes below it."""

    path: str
    whole: bool


def _under(path: str, rules: Iterable[str]) -> bool:
    return any(path == r or path.startswith(f"{r}/") for r in rules)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.rules = [r for r in options.get("exclude", "").split("\n") if r]
        self.contents = options.get("contents", "true").lower() == "true"
        if not os.path.isdir(self.root):
            raise ValueError(f"no folder at {self.root}")

    def passed(self, entry: os.DirEntry, path: str) -> str | None:
        """Why an entry is passed over, or None."""
        if entry.is_symlink():
            return "link"
        if _under(path, self.rules):
            return "excluded"
        return "pruned" if entry.name in PRUNED and entry.is_dir(follow_symlinks=False) else None

    def partitions(self) -> list[Folder]:
        """The folders of the first levels, each alone, and those below them with all that they hold."""
        found, level = [], [""]
        for deep in range(DEEP + 1):
            below = []
            for folder in level:
                found.append(Folder(folder, deep == DEEP))
                if deep < DEEP:
                    with os.scandir(os.path.join(self.root, folder)) as entries:
                        below += [p for e in entries if (p := os.path.join(folder, e.name)) and e.is_dir(follow_symlinks=False) and not self.passed(e, p)]
            level = sorted(below)
        return found

    def read(self, partition: Folder) -> Iterator[tuple]:
        folders = [partition.path]
        while folders:
            folder = folders.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in sorted(entries, key=lambda e: e.name):
                    path = os.path.join(folder, entry.name)
                    why = self.passed(entry, path)
                    if why:
                        yield path, why, None, None, None
                    elif entry.is_dir(follow_symlinks=False):
                        folders += [path] if partition.whole else []
                    elif entry.is_file(follow_symlinks=False):
                        yield self.file(entry, path)

    def file(self, entry: os.DirEntry, path: str) -> tuple:
        """A file over the size, one that cannot be opened or is not UTF-8 has no text."""
        size = entry.stat(follow_symlinks=False).st_size
        if not self.contents or size > self.most:
            return path, "file", size, None, None
        try:
            with open(entry.path, "rb") as held:
                data = held.read()
        except OSError:
            return path, "file", size, None, None
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = None
        return path, "file", size, hashlib.sha256(data).hexdigest(), text


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_source_tree(spark: SparkSession, root: str, repository_id: str, exclude: Iterable[str] = (), max_bytes: int = MAX_BYTES, contents: bool = True) -> DataFrame:
    """repository_id, path, kind (file, link, pruned, excluded), length, sha256 and text (null where it was not read or is not UTF-8)."""
    rules = [r.replace("\\", "/").strip("/").removeprefix("./") for r in exclude]
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("source_tree").options(exclude="\n".join(rules), maxBytes=str(max_bytes), contents=str(contents).lower()).load(str(root))
    return rows.select(F.lit(repository_id).alias("repository_id"), "path", "kind", "length", "sha256", "text")
