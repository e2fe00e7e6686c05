"""Inventories of a folder that driver and executors share, as a data source of Spark's: `spark.read.format("inventory").load(root)`.

The driver looks at the upper levels alone, until there are folders enough to deal out; each task walks its own. Links are never followed
and never listed as files. What can't be read fails the scan: an unreadable folder is not an empty one."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

SCHEMA = "path string, name string, type string, bytes long, modified_ns long"
#: Kind of a file by its suffix; others aren't candidates.
KINDS = {"wav": "audio", "mp3": "audio", "flac": "audio", "json": "data", "jsonl": "data", "txt": "text", "md": "text"}
DAY_NS = 24 * 3600 * 10**9


class ScanError(ValueError):
    """A scan that makes no claim, for the reason that it names."""


@dataclass
class Part(InputPartition):
    folders: list[str]
    deep: bool

    def __init__(self, folders: list[str], deep: bool):
        super().__init__((tuple(folders), deep))
        self.folders, self.deep = folders, deep


def _entries(folder: str) -> list[tuple[str, os.stat_result]]:
    """Names and states of a folder's entries, by name; links as links."""
    try:
        with os.scandir(folder) as found:
            return sorted(((e.name, e.stat(follow_symlinks=False)) for e in found), key=lambda x: x[0])
    except OSError as e:
        raise ScanError(f"DIRECTORY_SCAN_FAILED {folder}") from e


def _type(mode: int) -> str:
    return "link" if stat.S_ISLNK(mode) else "folder" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"


class TreeReader(DataSourceReader):
    def __init__(self, root: str, recursive: bool, parts: int):
        if os.path.islink(root) or not os.path.isdir(root):
            raise ScanError("ROOT_NOT_LOCAL_DIRECTORY")
        self.root, self.recursive, self.parts = os.path.realpath(root), recursive, parts

    def partitions(self) -> list[Part]:
        """Single folders of the upper levels, and whole subtrees below."""
        single, trees = [], [self.root]
        while self.recursive and trees and len(trees) < self.parts:
            below = [os.path.join(f, name) for f in trees for name, s in _entries(f) if stat.S_ISDIR(s.st_mode)]
            single, trees = single + trees, below
        if not self.recursive:
            return [Part([self.root], False)]
        parts = [Part(trees[k :: self.parts], True) for k in range(self.parts)] + [Part(single[k :: self.parts], False) for k in range(self.parts)]
        return [p for p in parts if p.folders] or [Part([self.root], False)]

    def read(self, partition: Part) -> Iterator[tuple]:
        todo = list(partition.folders)
        while todo:
            folder = todo.pop()
            for name, s in _entries(folder):
                kind, path = _type(s.st_mode), os.path.join(folder, name)
                yield os.path.relpath(path, self.root).replace(os.sep, "/"), name, kind, s.st_size, s.st_mtime_ns
                if kind == "folder" and partition.deep:
                    todo.append(path)


class Tree(DataSource):
    """Options: path, recursive (true), parts (8)."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("recursive", "true").lower() == "true", int(self.options.get("parts", "8")))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Tree)
    return ship(spark)


def entries(spark: SparkSession, root: str, recursive: bool = True, parts: int = 8) -> DataFrame:
    """(path, name, type, bytes, modified_ns) of everything below `root` or in it."""
    return register(spark).read.format("inventory").option("recursive", str(recursive)).option("parts", parts).load(root)


def inventory(spark: SparkSession, root: str, most: int = 5000, kinds: dict[str, str] = KINDS, expected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The files of a known kind (path, bytes, modified_ns, kind), and one row about them: n_files, n_bytes, kinds (counts), fingerprint. More
    than `most` files are refused, as part of them would be no inventory; that makes the fingerprint a digest of a bounded list. `expected`: the
    fingerprint that the folder had; another one is refused."""
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    files = entries(spark, root).where("type = 'file'").select("path", "bytes", "modified_ns", F.try_element_at(known, suffix).alias("kind")).where("kind is not null")
    rows = files.limit(most + 1).collect()
    if len(rows) > most:
        raise ScanError("SCAN_LIMIT_EXCEEDED_NO_COMPLETE_CLAIM")
    held = spark.createDataFrame(rows, files.schema)
    counts = held.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    line = F.concat(F.to_json(F.array(F.col("path"))), F.lit(" "), F.concat_ws(" ", "bytes", "modified_ns", "kind"), F.lit("\n"))
    in_order = F.array_sort(F.collect_list(F.struct(F.lower("path").alias("k"), "path", line.alias("line"))))
    about = held.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"), F.sha2(F.array_join(F.transform(in_order, lambda x: x["line"]), ""), 256).alias("fingerprint"))
    about = about.crossJoin(counts).select("n_files", "n_bytes", F.coalesce("kinds", F.create_map().cast("map<string,bigint>")).alias("kinds"), "fingerprint")  # one row each
    if expected is not None and about.first().fingerprint != expected.lower():
        raise ScanError("METADATA_FINGERPRINT_CHANGED_FAIL_CLOSED")
    return held, about


def storage(spark: SparkSession, root: str, now_ns: int, most: int = 5000) -> DataFrame:
    """One row about the files that lie in `root` itself: n_files, n_bytes, n_old and old_bytes (of a week or more at `now_ns`), skipped_folders,
    skipped_links, complete. Folders and links are not looked into, and then the scan is not complete. More than `most` files are refused."""
    e = entries(spark, root, recursive=False)
    if e.where("type = 'file'").limit(most + 1).count() > most:
        raise ScanError("FILE_BUDGET_EXCEEDED_NO_COMPLETE_CLAIM")
    is_file, old = F.col("type") == "file", F.col("modified_ns") <= now_ns - 7 * DAY_NS
    total = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")
    out = e.agg(
        total(is_file, 1).alias("n_files"), total(is_file, F.col("bytes")).alias("n_bytes"), total(is_file & old, 1).alias("n_old"), total(is_file & old, F.col("bytes")).alias("old_bytes"),
        total(F.col("type") == "folder", 1).alias("skipped_folders"), total(F.col("type") == "link", 1).alias("skipped_links"),
    )
    return out.withColumn("complete", (F.col("skipped_folders") == 0) & (F.col("skipped_links") == 0))
