"""Exact deduplication by Grace hashing.

Records go into an open-addressing table that compares complete contents. When
its contents outgrow the budget, the records are partitioned to spill files by
the next bits of their hash, and each file is taken in the same way until a
bucket fits. The table runs twice: over each input partition, so that a hot
text leaves it once, and after one exchange by hash over what is left."""

from __future__ import annotations

import hashlib
import itertools
import os
import pickle
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import joined_to_classes, octets, small_batches, table, written

#: Bytes of contents and payloads that a table may hold.
BUDGET = 64 << 20
FANOUT_BITS = 4
#: Equal rows that are written out at a time.
CHUNK = 4096
HEAD = struct.Struct("<Qqqqqq")


class Bucket:
    """Distinct contents with the number of their rows, the largest id and that row's payload."""

    def __init__(self, budget: int = BUDGET, depth: int = 0, folder: str | None = None):
        self.budget, self.depth, self.folder = budget, depth, folder
        self.files: list | None = None
        self.clear()

    def clear(self) -> None:
        self.slots, self.mask, self.bytes = [-1] * 64, 63, 0
        self.hashes: list[int] = []
        self.rows: list[list] = []  # content, id, payload, count

    def add(self, h: int, content: bytes, best: int | None, payload: bytes, n: int = 1) -> None:
        if self.files is not None:
            self.spill(h, content, best, payload, n)
            return
        i = (h * 0x9E3779B97F4A7C15 >> 13) & self.mask
        while (r := self.slots[i]) >= 0:
            if self.hashes[r] == h:
                row = self.rows[r]
                if row[0] != content:
                    if hashlib.sha256(row[0]).digest() == hashlib.sha256(content).digest():
                        raise ValueError("two contents have one SHA-256; it can't name them apart")
                    i = (i + 1) & self.mask
                    continue
                row[3] += n
                if rank(best, payload) > rank(row[1], row[2]):
                    self.bytes += len(payload) - len(row[2])
                    row[1], row[2] = best, payload
                return
            i = (i + 1) & self.mask
        self.slots[i] = len(self.rows)
        self.hashes.append(h)
        self.rows.append([content, best, payload, n])
        self.bytes += len(content) + len(payload) + 200
        if 2 * len(self.rows) > self.mask:
            self.grow()
        if self.bytes > self.budget and len(self.rows) > 1 and FANOUT_BITS * (self.depth + 1) <= 64:
            self.partition()

    def grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for r, h in enumerate(self.hashes):
            i = (h * 0x9E3779B97F4A7C15 >> 13) & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = r

    def partition(self) -> None:
        self.folder = self.folder or tempfile.mkdtemp(prefix="grace-")
        self.files = [tempfile.NamedTemporaryFile(dir=self.folder, buffering=1 << 16, delete=False) for _ in range(1 << FANOUT_BITS)]
        hashes, rows = self.hashes, self.rows
        self.clear()
        for h, row in zip(hashes, rows):
            self.spill(h, *row)

    def spill(self, h: int, content: bytes, best: int | None, payload: bytes, n: int) -> None:
        f = self.files[h >> (64 - FANOUT_BITS * (self.depth + 1)) & (1 << FANOUT_BITS) - 1]
        f.write(HEAD.pack(h, n, best is not None, best or 0, len(content), len(payload)))
        f.write(content)
        f.write(payload)

    def results(self) -> Iterator[tuple[int, bytes, int | None, bytes, int]]:
        """Each distinct content once; spill files go as they are read."""
        if self.files is None:
            for h, row in zip(self.hashes, self.rows):
                yield h, *row
            self.clear()
            return
        try:
            for f in self.files:
                f.close()
            for f in self.files:
                below = Bucket(self.budget, self.depth + 1, self.folder)
                with open(f.name, "rb", buffering=1 << 20) as read:
                    while head := read.read(HEAD.size):
                        h, n, known, best, size, more = HEAD.unpack(head)
                        below.add(h, read.read(size), best if known else None, read.read(more), n)
                os.unlink(f.name)
                yield from below.results()
        finally:
            for f in self.files:
                if os.path.exists(f.name):
                    os.unlink(f.name)
            if self.depth == 0:
                os.rmdir(self.folder)


def rank(best: int | None, payload: bytes) -> tuple:
    return best is not None, best or 0, payload


NAMES = ["sha", "content", "best", "payload", "n"]
PACKED = "sha binary, content binary, best long, payload binary, n long"
TYPES = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64())


def packed(bucket: Bucket, write) -> Iterator[pa.RecordBatch]:
    """Batches, by ``write``, of what a table holds, of 8 MB or 2000 rows at most (but for one larger row)."""
    held, size = [], 0
    for _, content, best, payload, n in bucket.results():
        held.append((hashlib.sha256(content).digest(), content, best, payload, n))
        size += len(content) + len(payload)
        if size > 8 << 20 or len(held) >= 2000:
            yield write(held)
            held, size = [], 0
    if held:
        yield write(held)


def rows_of(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], names=NAMES)


def heads_of(held: list[tuple]) -> pa.RecordBatch:
    return rows_of([(sha, b"", *rest) for sha, _, *rest in held])


def classes(docs: DataFrame, read, write, schema, budget: int = BUDGET) -> DataFrame:
    """One row for each distinct content. ``read`` gives (content, id, payload)
    of each row of a batch of ``docs``; ``write`` makes batches of ``schema`` from
    rows (sha, content, id, payload, n). One Python worker a task, in either stage.

    Equal digests are dealt to one table, which compares contents; so that a
    digest may name its class afterwards, two contents of one digest are refused."""

    def add(bucket: Bucket, sha: bytes, content: bytes, *rest) -> None:
        bucket.add(int.from_bytes(sha[:8]), content, *rest)

    def local(batches):
        bucket = Bucket(budget)
        for batch in batches:
            for content, best, payload in read(batch):
                add(bucket, hashlib.sha256(content).digest(), content, best, payload)
        yield from packed(bucket, rows_of)

    def final(batches):
        bucket = Bucket(budget)
        for batch in batches:
            columns = (octets(batch.column(0)), octets(batch.column(1)), batch.column(2).to_pylist(), octets(batch.column(3)), batch.column(4).to_pylist())
            for row in zip(*columns):
                add(bucket, *row)
        yield from packed(bucket, write)

    small_batches(docs.sparkSession, 500)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.mapInArrow(local, PACKED).repartition(parts, "sha").mapInArrow(final, schema)


def verdicts(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of (doc_id, text).

    Null texts count as empty; an empty table gives none; texts of any length are
    compared whole. The row with the largest doc_id stays; a null doc_id is
    smaller than any, so keep_id is null only where all ids of a group are. Of
    rows that repeat both the text and that doc_id, one is kept: rows equal in
    both are counted first, so that they take one row in the exchange and join,
    however many they are."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))

    def read(batch):
        return zip(octets(batch.column(1)), batch.column(0).to_pylist(), itertools.repeat(b""))

    groups = written(classes(docs, read, heads_of, PACKED, budget).select("sha", F.col("best").alias("keep_id"), F.col("n").alias("group_size")), "classes")
    members = docs.groupBy(F.unhex(F.sha2("content", 256)).alias("sha"), "doc_id").agg(F.count("*").alias("__same"))
    joined = joined_to_classes(members, groups, "sha", "group_size", F.xxhash64("doc_id"))
    # equal rows again, CHUNK at a time: the first of those that have the keep_id stays
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__same") - 1, F.lit(CHUNK).cast("long"))).alias("__from")
    copy = F.explode(F.sequence("__from", F.least(F.col("__from") + CHUNK, F.col("__same")) - 1)).alias("__copy")
    fields = ["doc_id", "keep_id", "group_size", "sha"]
    rows = joined.select(*fields, "__same", chunk).select(*fields, copy)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 0)
    return rows.select(*fields[:3], kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows that stay, whole, with the columns of ``docs`` (any names): the
    row travels as payload beside its text, so one exchange suffices. Which row
    of a group stays is as in ``verdicts``; a null text stays null if its row does."""
    names = docs.columns
    others = [n for n in names if n != "text"]
    types = to_arrow_schema(docs.schema)

    def read(batch):
        null = batch.column("text").is_null().to_pylist()
        rest = zip(null, *(batch.column(n).to_pylist() for n in others))
        for content, best, row in zip(octets(batch.column("text")), batch.column("doc_id").cast(pa.int64()).to_pylist(), rest):
            yield content or b"", best, pickle.dumps(row)

    def write(held):
        rows = [pickle.loads(p) for _, _, _, p, _ in held]
        text = [None if r[0] else c.decode() for r, (_, c, *_) in zip(rows, held)]
        by = {n: [r[k + 1] for r in rows] for k, n in enumerate(others)} | {"text": text}
        return pa.RecordBatch.from_arrays([pa.array(by[n], types.field(n).type) for n in names], names=names)

    return classes(docs, read, write, docs.schema, budget)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
