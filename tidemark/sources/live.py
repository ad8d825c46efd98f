"""A streaming source of growing text files: a collector appends lines to the file of a day and goes on to the next one.

The offset is how many bytes of each file have been read, up to its last whole line. A batch reads, of every file that has grown, what
lies between two offsets, one task a file, and CHUNK bytes at most, so that a late start does not read a day at once. A restart
from the checkpoint goes on where the last batch ended; nothing is lost or read twice when a new day's file begins.
Files are reached through pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 64 << 20


class Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int) -> None:
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


class GrowingFiles(DataSource):
    """Format `growing_files`: file, line. Options: path (a folder), pattern (of names, all by default), chunk (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "file string, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern, self.chunk = options["path"], options.get("pattern", "*"), int(options.get("chunk", CHUNK))
        self.seen: dict[str, int] = {}

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """For each file: the end of the last whole line, no further than a chunk beyond what was named before."""
        store, folder = self._open()
        out = dict(self.seen)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and fnmatch.fnmatch(info.base_name, self.pattern):
                start = out.get(info.base_name, 0)
                if info.size > start:
                    with store.open_input_file(info.path) as f:
                        data = f.read_at(min(self.chunk, info.size - start), start)
                    # a line longer than a chunk waits for a larger one
                    out[info.base_name] = start + data.rfind(b"\n") + 1
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = {k: max(v, self.seen.get(k, 0)) for k, v in end.items()}
        return [Piece(name, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)]

    def read(self, partition: Piece) -> Iterator[tuple[str, str]]:
        store, folder = self._open()
        with store.open_input_file(f"{folder}/{partition.name}") as f:
            data = f.read_at(partition.end - partition.start, partition.start)
        for line in data.decode("utf-8", "replace").split("\n")[:-1]:
            yield partition.name, line.rstrip("\r")

    def commit(self, end: dict) -> None:
        pass


def lines(spark: SparkSession, path: str, pattern: str = "*", chunk: int = CHUNK) -> DataFrame:
    """The lines of growing files as a stream: file, line."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", path).option("pattern", pattern).option("chunk", chunk).load()


def trades(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Collected trades of all days: ts, price, qty, is_buyer_maker. Headers, and rows without a price, are dropped."""
    read = F.from_csv("line", "timestamp_ms long, price double, quantity double, is_buyer_maker string")
    raw = lines(spark, path, pattern).select(read.alias("r")).select("r.*").filter("price > 0")
    return raw.select(F.timestamp_millis("timestamp_ms").alias("ts"), "price", F.col("quantity").alias("qty"), (F.lower(F.trim("is_buyer_maker")) == "true").alias("is_buyer_maker"))


def order_book(spark: SparkSession, path: str, pattern: str = "*.csv", levels: int = 20) -> DataFrame:
    """Collected snapshots of all days: ts, bids and asks as arrays of (price, size); blank levels are left out."""
    names = [f"{side}_{x}{k}" for side in ("bid", "ask") for k in range(1, levels + 1) for x in "pq"]
    read = F.from_csv("line", "timestamp_ms long, " + ", ".join(f"{n} double" for n in names))
    raw = lines(spark, path, pattern).select(read.alias("r")).select("r.*").filter("timestamp_ms IS NOT NULL")

    def side(name: str) -> Column:
        every = F.array(*[F.struct(F.col(f"{name}_p{k}").alias("price"), F.col(f"{name}_q{k}").alias("size")) for k in range(1, levels + 1)])
        return F.filter(every, lambda x: x["price"].isNotNull())

    return raw.select(F.timestamp_millis("timestamp_ms").alias("ts"), side("bid").alias("bids"), side("ask").alias("asks"))
