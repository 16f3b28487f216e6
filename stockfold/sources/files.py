"""File sources and sinks of the ledger: request batches as JSON lines, log
records as JSON, load datasets with their manifest, soak samples as CSV.

JSON is taken strictly, through VARIANT: a number in quotes, a fraction, an
explicit null or a missing field is not the integer or text that is asked for.
Unknown fields are passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bad_identifier
from ..schema import FIELDS, LOG_RECORD, MOST_BATCH, MOST_DELTA, OPERATION


def part(v: Column, name: str, kind: str, sql: str) -> Column:
    """A field of a VARIANT if it is of that kind, else null."""
    x = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(x) == kind, F.try_variant_get(v, f"$.{name}", sql))


def text(v: Column, name: str) -> Column:
    return part(v, name, "STRING", "string")


def whole(v: Column, name: str) -> Column:
    return part(v, name, "BIGINT", "long")


def elements(v: Column) -> Column:
    """A VARIANT's elements if it is an array, else null."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def operation(v: Column) -> Column:
    """An operation from a VARIANT; what is not of the field's type is null. Only
    an absent event_version is 1."""
    version = F.when(F.try_variant_get(v, "$.event_version", "variant").isNull(), F.lit(1).cast("long")).otherwise(whole(v, "event_version"))
    return F.struct(*(text(v, n).alias(n) for n in ("operation_id", "owner_id", "sku")), whole(v, "delta").alias("delta"), version.alias("event_version"))


def malformed(o: Column) -> Column:
    """Whether a parsed operation lacks a field or has one of another type."""
    return o["operation_id"].isNull() | o["owner_id"].isNull() | o["sku"].isNull() | o["delta"].isNull() | o["event_version"].isNull()


def why(o: Column) -> Column:
    """``reason`` for an element of an array."""
    bad = [(bad_identifier(o[n]), f"invalid {n}") for n in ("operation_id", "owner_id", "sku")]
    bad += [(o["delta"] == 0, "zero delta"), (~o["delta"].between(-MOST_DELTA, MOST_DELTA), "delta out of range"), (o["event_version"] != 1, "unsupported version")]
    return F.coalesce(*(F.when(b, r) for b, r in bad))


def decode(lines: DataFrame, column: str = "value", rules: bool = True) -> DataFrame:
    """Adds record_type, epoch, owner, operations and payload (the line's bytes)
    of a log line by the first form that fits: a tagged object, a bare array
    (epoch 0), else poison. One malformed or invalid operation makes the whole
    record poison; a record may have no operations, or any number. Without
    ``rules`` the form alone decides, so a record whose operations are well formed
    but invalid (a delta of zero, say) keeps them."""
    c = F.col(column)
    rows = lines.withColumn("_v", F.try_parse_json(c))
    v = F.col("_v")
    bare = F.schema_of_variant(v).startswith("ARRAY")
    rows = rows.withColumn("_bare", F.coalesce(bare, F.lit(False))).withColumn("_kind", F.when(F.col("_bare"), "operations").otherwise(text(v, "record_type")))
    listed = F.coalesce(F.when(F.col("_bare"), elements(v)), elements(F.try_variant_get(v, "$.operations", "variant")))
    rows = rows.withColumn("_ops", F.transform(listed, operation)).withColumn("_epoch", F.when(F.col("_bare"), F.lit(0).cast("long")).otherwise(whole(v, "epoch"))).withColumn("_owner", text(v, "owner"))
    invalid = F.exists("_ops", lambda o: malformed(o) | why(o).isNotNull() if rules else malformed(o))
    good_ops = (F.col("_kind") == "operations") & (F.col("_epoch") >= 0) & F.col("_ops").isNotNull() & ~invalid
    good_fence = (F.col("_kind") == "fence") & (F.col("_epoch") >= 0) & F.col("_owner").isNotNull()
    rows = rows.withColumn("_good", F.coalesce(good_ops | good_fence, F.lit(False)))
    good = F.col("_good")
    found = F.struct(
        F.when(good, F.col("_kind")).otherwise("poison").alias("record_type"), F.when(good, F.col("_epoch")).alias("epoch"),
        F.when(good & (F.col("_kind") == "fence"), F.col("_owner")).alias("owner"), F.when(good & (F.col("_kind") == "operations"), F.col("_ops")).alias("operations"),
    )
    # an explode, as filters are not pushed below it: a filter would repeat the whole parsing at every mention of a column
    rows = rows.withColumn("_found", F.explode(F.array(found)))
    got = {n: F.col(f"_found.{n}") for n in ("record_type", "epoch", "owner", "operations")}
    return rows.withColumns(got | {"payload": F.encode(c, "UTF-8")}).drop("_v", "_bare", "_kind", "_ops", "_epoch", "_owner", "_good", "_found")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines ``{"sequence": n, "record": "..."}``."""
    raw = spark.read.schema("sequence long, record string").json(path)
    return decode(raw, "record").select(LOG_RECORD.names)


def parse_batches(lines: DataFrame) -> DataFrame:
    """Request batches (line, value) by element: line, batch_size, pos, the
    operation, and refused: why the whole batch is refused, null if it is not.

    The checks in order: JSON of an array of operations, 1 to MOST_BATCH of them,
    then each operation in turn. A line that is no array has one row without pos."""
    v = F.try_parse_json("value")
    rows = lines.withColumn("_ops", F.transform(elements(v), operation))
    bad = F.filter(F.transform("_ops", why), lambda r: r.isNotNull())
    refused = F.coalesce(
        F.when(F.col("_ops").isNull() | F.exists("_ops", malformed), "invalid JSON batch"),
        F.when(~F.size("_ops").between(1, MOST_BATCH), f"batch must contain 1..={MOST_BATCH} operations"), F.get(bad, F.lit(0)),
    )
    rows = rows.select("line", F.when(F.col("_ops").isNotNull(), F.size("_ops")).alias("batch_size"), refused.alias("refused"), "_ops")
    # only now, so that a batch is judged once and not for each of its rows
    return rows.select("line", "batch_size", "refused", F.posexplode_outer("_ops").alias("pos", "o")).select("line", "batch_size", "pos", "o.*", "refused")


def parse_operations(lines: DataFrame) -> DataFrame:
    """Requests of one operation each (line, value: a JSON object), as batches of one."""
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    return parse_batches(lines.withColumn("value", F.when(blank, "").otherwise(F.concat(F.lit("["), "value", F.lit("]")))))


def read_batches(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """One request batch a line of text; ``columns`` of the operations (all, or
    only ids, say): the others are not kept."""
    got = parse_batches(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))
    return got.select("line", "batch_size", "pos", *columns, "refused")


def batch_lines(ops: DataFrame, by: str, batch: int) -> DataFrame:
    """Operations in the order of ``by``, ``batch`` to a JSON line: line, value."""
    groups = ops.groupBy(F.floor(F.col(by) / batch).alias("line")).agg(F.sort_array(F.collect_list(F.struct(by, *FIELDS))).alias("o"))
    return groups.select("line", F.to_json(F.transform("o", lambda o: F.struct(*(o[n].alias(n) for n in FIELDS)))).alias("value"))


def write_batches(ops: DataFrame, path: str, batch: int = 1000) -> None:
    """Operations by ``i`` as JSON lines of ``batch`` each."""
    batch_lines(ops, "i", batch).select("value").write.text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, SHA-256 and CRC-32 of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Soak samples as CSV with a header."""
    samples.write.option("header", True).csv(path)


def read_samples(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def log_lines(records: DataFrame) -> DataFrame:
    """Records (sequence, record_type, epoch, owner, operations) as log lines
    (sequence, value) that ``decode`` reads; a poison record has its payload."""
    ops = F.to_json(F.struct("record_type", "epoch", "operations"))
    fence = F.to_json(F.struct("record_type", "epoch", "owner"))
    value = F.when(F.col("record_type") == "fence", fence).when(F.col("record_type") == "operations", ops).otherwise(F.decode("payload", "UTF-8"))
    return records.select("sequence", value.alias("value"))


OPERATIONS = f"array<{OPERATION.simpleString()}>"
