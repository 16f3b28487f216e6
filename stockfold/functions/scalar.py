"""Column functions: validation, fingerprints, derived keys. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MOST_BATCH, MOST_DELTA, MOST_ID_BYTES


def bad_identifier(c: Column) -> Column:
    """Not 1 to 128 bytes, outer white space (any Unicode white space), or a control character."""
    return ~F.octet_length(c).between(1, MOST_ID_BYTES) | c.rlike(r"(?U)^\s|\s$") | c.rlike(r"\p{Cc}")


def reason(prefix: str = "") -> Column:
    """Why an operation is invalid, in the order of the checks; null if it is valid."""
    c = lambda n: F.col(prefix + n)
    checks = [(c(n).isNull() | bad_identifier(c(n)), f"invalid {n}") for n in ("operation_id", "owner_id", "sku")]
    checks += [
        (c("delta").isNull(), "missing delta"), (c("delta") == 0, "zero delta"),
        (~c("delta").between(-MOST_DELTA, MOST_DELTA), "delta out of range"),
        (c("event_version").isNull() | (c("event_version") != 1), "unsupported version"),
    ]
    return F.coalesce(*(F.when(bad, why) for bad, why in checks))


def batch_size_ok(operations: Column) -> Column:
    return F.size(operations).between(1, MOST_BATCH)


def little_endian(x: Column) -> Column:
    """A 64-bit integer as 16 hex digits, least byte first."""
    return F.regexp_replace(F.lpad(F.hex(x), 16, "0"), "(..)" * 8, "".join(f"${k}" for k in range(8, 0, -1)))


def fingerprint(prefix: str = "") -> Column:
    """SHA-256 of owner, sku, delta and version, each after its length; not of the id."""
    c = lambda n: F.col(prefix + n)
    text = lambda x: F.concat(little_endian(F.octet_length(x).cast("long")), F.hex(F.encode(x, "UTF-8")))
    number = lambda x: F.concat(F.lit("0800000000000000"), little_endian(x))
    return F.sha2(F.unhex(F.concat(text(c("owner_id")), text(c("sku")), number(c("delta")), number(c("event_version")))), 256)


def shard(c: Column, shards: int) -> Column:
    """Shard of an id by the first byte of its hash; ``shards`` up to 256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("long") % shards


def saturating_lag(last: Column, done: Column) -> Column:
    return F.greatest(last - done, F.lit(0))


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(25) * F.pow(F.lit(2), F.least(attempt, F.lit(4))), F.lit(500)).cast("long")


def same(a: str, b: str, names: list[str]) -> Column:
    """Whether the named columns of two aliases agree, nulls included."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))
