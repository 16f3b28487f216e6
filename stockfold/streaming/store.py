"""A folder of Parquet tables in versions, one for each micro-batch.

A version's tables are written first and its meta row (sequence, writer_epoch)
last; a version counts once that row is there, so all its tables, and how far
they have come, appear together. Writing a version again overwrites it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIELDS, OPERATION

OPS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OPERATION.fields)
#: The tables that there may be.
TABLES = {
    "results": f"batch long, pos int, {OPS}, status string, balance long",
    "seen": OPS,
    "balances": "owner_id string, sku string, balance long",
    "rejected": "batch long, operation_id string, reason string",
    "dead": "source_stream string, source_sequence long, reason string, payload binary",
    "history": f"sequence long, pos int, {OPS}",
    "meta": "sequence long, writer_epoch long",
}
#: Tables of which each version holds all there is; the others hold what is new.
WHOLE = ("balances", "meta")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *names: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def listed(self, pattern: str) -> list[int]:
        """Versions by a pattern; one listing, however many there are."""
        fs, path = self.path(pattern)
        return sorted(int(x.getPath().getParent().getName().removeprefix("v=")) for x in fs.globStatus(path) or ())

    def versions(self) -> list[int]:
        return self.listed("meta/v=*/_SUCCESS")

    def write(self, kind: str, version: int, rows: DataFrame, sort: str | None = None) -> None:
        rows = rows.select(*(x.split()[0] for x in TABLES[kind].split(", ")))
        if sort:
            rows = rows.sortWithinPartitions(sort)
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#operation_id", kind in ("seen", "history")).parquet(f"{self.root}/{kind}/v={version}")

    def commit(self, version: int, sequence: int, epoch: int) -> None:
        """Makes the version count."""
        self.write("meta", version, self.spark.createDataFrame([(sequence, epoch)], TABLES["meta"]).coalesce(1))

    def read(self, kind: str, before: int | None = None, base_before: int | None = None) -> DataFrame:
        """A table over all versions that count, or those before one. Compacted
        tables (of versions before ``base_before``) stand for the versions up to theirs."""
        done = [v for v in self.versions() if before is None or v < before]
        own = [v for v in self.listed(f"{kind}/v=*/_SUCCESS") if v in set(done)]
        if kind in WHOLE:
            own = own[-1:]
        paths = [f"{self.root}/{kind}/v={v}" for v in own]
        if bases := [v for v in self.listed(f"{kind}-base/v=*/_SUCCESS") if v in set(done)]:
            paths = [f"{self.root}/{kind}-base/v={bases[-1]}", *(f"{self.root}/{kind}/v={v}" for v in own if v > bases[-1])]
        if not paths:
            return self.spark.createDataFrame([], TABLES[kind])
        return self.spark.read.schema(TABLES[kind]).parquet(*paths)

    def compact(self, kind: str, version: int, by: str) -> None:
        """One table, in ranges of ``by``, of all versions up to a committed one.
        What it stands for stays, for a micro-batch that runs again."""
        rows = self.read(kind, version + 1, version)
        rows.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").option("parquet.bloom.filter.enabled#operation_id", True).parquet(f"{self.root}/{kind}-base/v={version}")

    def progress(self, before: int | None = None) -> tuple[int, int]:
        """(sequence, writer epoch) of the last version; (-1, 0) without any."""
        row = self.read("meta", before).first()
        return (row.sequence, row.writer_epoch) if row else (-1, 0)

    def seen(self, before: int | None = None) -> DataFrame:
        return self.read("seen", before).select(FIELDS)

    def dead_letters(self) -> DataFrame:
        """One row for each source record, however often it was met."""
        own = F.min(F.struct("reason", "payload")).alias("r")
        return self.read("dead").groupBy("source_stream", "source_sequence").agg(own).select("source_stream", "source_sequence", "r.*")

    def set_aside(self) -> str:
        """Renames a damaged store, so that it can be built anew from the log."""
        fs, path = self.path()
        target = f"{self.root}.corrupt-{time.time_ns()}"
        if not fs.rename(path, self.path("..", target.rsplit("/", 1)[-1])[1]):
            raise OSError(f"{self.root} could not be set aside")
        return target
