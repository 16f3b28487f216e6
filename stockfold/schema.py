"""Schemas of the ledger. They are always given, never inferred."""

from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

OPERATION = StructType([
    StructField("operation_id", StringType()),
    StructField("owner_id", StringType()),
    StructField("sku", StringType()),
    StructField("delta", LongType()),
    StructField("event_version", LongType()),
])
LOG_RECORD = StructType([
    StructField("sequence", LongType()),
    StructField("record_type", StringType()),
    StructField("epoch", LongType()),
    StructField("owner", StringType()),
    StructField("operations", ArrayType(OPERATION)),
    StructField("payload", BinaryType()),
])
APPLIED = StructType([StructField("sequence", LongType()), StructField("pos", IntegerType()), *OPERATION.fields, StructField("status", StringType()), StructField("balance", LongType())])

PAYLOAD = ["owner_id", "sku", "delta", "event_version"]
FIELDS = OPERATION.names

#: Limits of identifiers, quantities, batches and pages.
MOST_ID_BYTES = 128
MOST_DELTA = 1_000_000_000
MOST_BATCH = 10_000
MOST_SCAN, MOST_INDEX = 10_000, 1_000
