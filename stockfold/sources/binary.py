"""Imports of checksummed binary files: write-ahead logs, snapshots and
checkpoints. Such a file is a sequence of records of which each tells where the
next one begins, so a file is read by one task (Arrow batches, many files at a
time); files are small by their formats' own limits."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import OPERATION

#: Marks and limits of the formats.
OPERATION_MARK, LOG_MARK, CHECKPOINT_MARK = b"WOP1", b"WLG1", b"WCP1"
SNAPSHOT_MARK, LEGACY_SNAPSHOT_MARK = b"WHSNAP02", b"WHSNAP01"
MOST_RECORD, MOST_OPERATIONS, MOST_ENTRIES = 1 << 20, 100_000, 100_000_000
SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OPERATION.fields)


class Corrupt(ValueError):
    """The file is damaged; it has to be set aside and rebuilt from the log."""


class Cursor:
    """Little-endian values one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Corrupt("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        raw = self.take(self.number("H"))
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise Corrupt("text is not UTF-8") from e

    def operation(self) -> tuple:
        return self.text(), self.text(), self.text(), self.number("q"), self.number("Q")

    def end(self) -> None:
        if self.at != len(self.data):
            raise Corrupt("trailing bytes")


def long_text(x: str) -> bytes:
    raw = x.encode()
    return struct.pack("<H", len(raw)) + raw


def operation_bytes(op: tuple) -> bytes:
    return b"".join(map(long_text, op[:3])) + struct.pack("<qQ", op[3], op[4])


def one_operation(data: bytes) -> tuple:
    """Binary, else JSON."""
    if data.startswith(OPERATION_MARK):
        c = Cursor(data, 4)
        op = c.operation()
        c.end()
        return op
    try:
        o = json.loads(data)
        return o["operation_id"], o["owner_id"], o["sku"], int(o["delta"]), int(o.get("event_version", 1))
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt("neither a binary nor a JSON operation") from e


def log_record(data: bytes) -> tuple[str, int, str | None, list[tuple] | None]:
    """(record_type, epoch, owner, operations) of a binary log record."""
    if not data.startswith(LOG_MARK):
        raise Corrupt("not a binary log record")
    c = Cursor(data, 4)
    kind, epoch = c.number("B"), c.number("Q")
    if kind == 1:
        got = "fence", epoch, c.text(), None
    elif kind == 2:
        n = c.number("I")
        if n > MOST_OPERATIONS:
            raise Corrupt("too many operations")
        got = "operations", epoch, None, [c.operation() for _ in range(n)]
    else:
        raise Corrupt("unknown kind of record")
    c.end()
    return got


def wal_records(data: bytes) -> Iterator[tuple]:
    """Operations of a write-ahead log. A torn record at the end is left out; a
    wrong checksum is damage."""
    at = 0
    while len(data) - at >= 8:
        size, crc = struct.unpack_from("<II", data, at)
        if size > MOST_RECORD:
            raise Corrupt("record is too long")
        if at + 8 + size > len(data):
            return
        payload = data[at + 8 : at + 8 + size]
        if zlib.crc32(payload) != crc:
            raise Corrupt("wrong checksum")
        yield one_operation(payload)
        at += 8 + size


def wal_bytes(ops: list[tuple]) -> bytes:
    out = []
    for op in ops:
        payload = OPERATION_MARK + operation_bytes(op)
        out.append(struct.pack("<II", len(payload), zlib.crc32(payload)) + payload)
    return b"".join(out)


def snapshot(data: bytes) -> tuple[int, int, list[tuple[str, str, int]]]:
    """(sequence, writer epoch, balances) of a snapshot file."""
    if len(data) < 48 or data[:8] not in (SNAPSHOT_MARK, LEGACY_SNAPSHOT_MARK):
        raise Corrupt("not a snapshot")
    body = data[48:]
    if struct.unpack_from("<Q", data, 8)[0] != len(body) or hashlib.sha256(body).digest() != data[16:48]:
        raise Corrupt("wrong length or checksum")
    if data[:8] == LEGACY_SNAPSHOT_MARK:
        o = json.loads(body)
        if not 1 <= o["version"] <= 3:
            raise Corrupt("unsupported version")
        return o["sequence"], o.get("writer_epoch", 0), [(b["owner_id"], b["sku"], b["balance"]) for b in o["balances"]]
    c = Cursor(body)
    version, sequence = c.number("I"), c.number("Q")
    if not 1 <= version <= 3:
        raise Corrupt("unsupported version")

    def count() -> int:
        n = c.number("Q")
        if n > MOST_ENTRIES:
            raise Corrupt("too many entries")
        return n

    balances = [(c.text(), c.text(), c.number("q")) for _ in range(count())]
    for _ in range(count()):
        c.text()
        c.take(32)
    epoch = c.number("Q") if version >= 3 else 0
    c.end()
    return sequence, epoch, balances


def snapshot_bytes(sequence: int, epoch: int, balances: list[tuple[str, str, int]]) -> bytes:
    body = struct.pack("<IQQ", 3, sequence, len(balances)) + b"".join(long_text(o) + long_text(s) + struct.pack("<q", b) for o, s, b in balances)
    body += struct.pack("<QQ", 0, epoch)
    return SNAPSHOT_MARK + struct.pack("<Q", len(body)) + hashlib.sha256(body).digest() + body


def checkpoint(data: bytes) -> tuple[int, int]:
    """(sequence, writer epoch): binary, JSON, or a bare number."""
    if data.startswith(CHECKPOINT_MARK):
        if len(data) != 20:
            raise Corrupt("wrong length")
        return struct.unpack_from("<QQ", data, 4)
    try:
        o = json.loads(data)
        return (o["sequence"], o["writer_epoch"]) if isinstance(o, dict) else (int(o), 0)
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt("not a checkpoint") from e


def rows_of(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """Rows of ``read`` for each file of ``path``: file, then ``schema``, then
    error, which alone is set for a damaged file: such a file has one row."""
    names = ["file", *(x.split()[0] for x in schema.split(", ")), "error"]

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(name, *r, None) for r in read(data)]
                except Corrupt as e:
                    rows = [(name, *[None] * (len(names) - 2), str(e))]
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, types.field(n).type) for n, c in zip(names, columns)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = f"file string, {schema}, error string"
    types = to_arrow_schema(StructType.fromDDL(whole))
    return files.mapInArrow(run, whole)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """file, pos and operation of every whole record; error for damaged files."""
    return rows_of(spark, path, lambda data: ((k, *op) for k, op in enumerate(wal_records(data))), f"pos long, {SCHEMA}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """file, sequence, writer_epoch, owner_id, sku and balance; error for damaged files."""

    def read(data):
        sequence, epoch, balances = snapshot(data)
        return ((sequence, epoch, *b) for b in balances)

    return rows_of(spark, path, read, "sequence long, writer_epoch long, owner_id string, sku string, balance long")
