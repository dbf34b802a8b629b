"""Object listings as a data source: register(spark), then `spark.read.format("object_inventory")`."""

from __future__ import annotations

import datetime
import importlib
import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

SCHEMA = "key string, size long, etag string, last_modified timestamp"
#: (key, size, etag, modified) for an object, or (key with a slash at its end, None, None, None) for a level below.
Entry = tuple[str, int | None, str | None, datetime.datetime | None]


def list_folder(root: str, prefix: str) -> Iterator[Entry]:
    """One level of a mounted folder: what starts with prefix, up to the next slash. An etag is made of size and time."""
    at = prefix[: prefix.rfind("/") + 1]
    folder = os.path.join(root, at)
    if not os.path.isdir(folder):
        return
    with os.scandir(folder) as found:
        for e in sorted(found, key=lambda e: e.name):
            key = at + e.name
            if key.startswith(prefix):
                if e.is_dir():
                    yield f"{key}/", None, None, None
                else:
                    s = e.stat()
                    yield key, s.st_size, f"{s.st_size:x}-{s.st_mtime_ns:x}", datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC)


class Level(InputPartition):
    """A prefix to list with all below it, or, if shallow, the objects of one level."""

    def __init__(self, prefix: str, shallow: bool):
        super().__init__(prefix)
        self.prefix, self.shallow = prefix, shallow


class InventoryReader(DataSourceReader):
    """Lists one partition per level below the prefix. A filter on the start or the value of key narrows the prefix, so that other levels are never listed."""

    def __init__(self, root: str, prefix: str, lister: Callable[[str, str], Iterator[Entry]]):
        self.root, self.prefix, self.lister = root, prefix, lister

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            start = f.value if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("key",) and isinstance(f.value, str) else None
            if start is not None:
                start = self.base + start
                if start.startswith(self.prefix):
                    self.prefix = start
            yield f  # Spark still checks each row

    @property
    def base(self) -> str:
        """Keys are given without the folder part of the prefix that was asked for."""
        return self._base if hasattr(self, "_base") else self.prefix[: self.prefix.rfind("/") + 1]

    def fixed(self) -> InventoryReader:
        self._base = self.base
        return self

    def partitions(self) -> list[InputPartition]:
        levels = [e[0] for e in self.lister(self.root, self.prefix) if e[0].endswith("/")]
        return [Level(self.prefix, True), *[Level(x, False) for x in levels]]

    def read(self, partition: Level) -> Iterator[tuple]:
        waiting = [partition.prefix]
        while waiting:
            for key, size, etag, modified in self.lister(self.root, waiting.pop()):
                if not key.endswith("/"):
                    yield key[len(self.base) :], size, etag, modified
                elif not partition.shallow:
                    waiting.append(key)


class ObjectInventory(DataSource):
    """Objects under a root, without directory marks, keys relative to the folder of the prefix.

    Options: path (the root), prefix, and lister, as "module:function", for stores other than mounted folders: it lists one level of a
    prefix. Listing runs in tasks, a level below the prefix each.
    """

    @classmethod
    def name(cls) -> str:
        return "object_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        lister = list_folder
        if "lister" in self.options:
            module, function = self.options["lister"].split(":")
            lister = getattr(importlib.import_module(module), function)
        return InventoryReader(self.options["path"], self.options.get("prefix", ""), lister).fixed()


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectInventory)
