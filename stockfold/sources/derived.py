"""Ledgers derived from the star-schema tables, as DataFrames. The SQL twins in
``LEDGERS`` say the same for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIELDS

#: Sequence distance of the redelivered copies in the third ledger.
REDELIVERY = 1_000_000

LEDGERS = {
    "l1": """SELECT event_id AS sequence, concat('evt-', event_id) AS operation_id, concat('user-', user_id) AS owner_id,
        event_type AS sku, (CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) * CAST(round(value * 100) AS BIGINT) AS delta,
        CAST(1 AS BIGINT) AS event_version FROM events""",
    "l2": """SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
            l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS sequence,
        concat(l_orderkey, '-', l_linenumber) AS operation_id, concat('supp-', l_suppkey) AS owner_id, concat('part-', l_partkey) AS sku,
        (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(round(l_quantity) AS BIGINT) AS delta,
        CAST(1 AS BIGINT) AS event_version FROM lineitem""",
    "l3": """SELECT * FROM l1 UNION ALL SELECT sequence + 1000000, operation_id, owner_id, sku, delta, event_version FROM l1 WHERE sequence % 10 = 0""",
    "l4_raw": """SELECT *, CASE WHEN sequence % 500 = 0 THEN 'fence' WHEN sequence % 101 = 0 THEN 'poison' ELSE 'operations' END AS record_type,
        CAST(floor(sequence / 500.0) AS BIGINT) + 1 AS fence_epoch FROM l1""",
    "l4_act": """SELECT *, coalesce(max(CASE WHEN record_type = 'fence' THEN fence_epoch END) OVER (ORDER BY sequence), 0) AS active FROM l4_raw""",
    "l4": """SELECT *, CASE WHEN record_type = 'fence' THEN fence_epoch WHEN record_type = 'poison' THEN NULL
        WHEN sequence % 97 = 0 THEN active - 1 ELSE active END AS epoch FROM l4_act""",
    "l4_lines": """SELECT *, CASE record_type WHEN 'fence' THEN '{"record_type":"fence","epoch":' || epoch || ',"owner":"writer-' || epoch || '"}'
        WHEN 'poison' THEN '{poison-' || sequence ELSE '{"record_type":"operations","epoch":' || epoch || ',"operations":[{"operation_id":"' || operation_id
        || '","owner_id":"' || owner_id || '","sku":"' || sku || '","delta":' || delta || ',"event_version":1}]}' END AS value FROM l4""",
    "l6": """SELECT event_id, epoch_us(ts) AS us, user_id % 2 AS instance, CAST(event_type = 'error' AS BIGINT) AS is_error, value FROM events""",
}
NEEDS = {"l3": ["l1"], "l4": ["l1", "l4_raw", "l4_act"], "l4_lines": ["l1", "l4_raw", "l4_act", "l4"]}


def with_ledgers(body: str, *names: str) -> str:
    wanted = list(dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n)))
    return "WITH " + ", ".join(f"{n} AS ({LEDGERS[n]})" for n in wanted) + " " + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one movement; ids are unique."""
    sign = F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sequence"), F.concat(F.lit("evt-"), "event_id").alias("operation_id"),
        F.concat(F.lit("user-"), "user_id").alias("owner_id"), F.col("event_type").alias("sku"),
        (sign * F.round(F.col("value") * 100).cast("long")).alias("delta"), F.lit(1).cast("long").alias("event_version"),
    )


#: The columns of a line item that order those of the same id; they are the tie-break of the second ledger.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids repeat with other payloads. ``arrival`` orders the rows of an id as
    the sequence of a total order would, without a global sort."""
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        F.struct(*LINE_ORDER).alias("arrival"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("operation_id"),
        F.concat(F.lit("supp-"), "l_suppkey").alias("owner_id"), F.concat(F.lit("part-"), "l_partkey").alias("sku"),
        (sign * F.round("l_quantity").cast("long")).alias("delta"), F.lit(1).cast("long").alias("event_version"),
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = clean(spark, sf_dir)
    return one.unionByName(one.where("sequence % 10 = 0").withColumn("sequence", F.col("sequence") + REDELIVERY))


def fenced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean ledger as log records with fences, poison and stale writers.
    Every 500th record, the 0th too, is a fence of the next epoch, so what the
    writers believe has a closed form."""
    fence = (F.floor(F.col("sequence") / 500) + 1).cast("long")
    kind = F.when(F.col("sequence") % 500 == 0, "fence").when(F.col("sequence") % 101 == 0, "poison").otherwise("operations")
    rows = clean(spark, sf_dir).withColumn("record_type", kind)
    epoch = F.when(kind == "fence", fence).when(kind == "poison", F.lit(None)).when(F.col("sequence") % 97 == 0, fence - 1).otherwise(fence)
    rows = rows.withColumn("epoch", epoch.cast("long")).withColumn("pos", F.lit(0))
    return rows.withColumn("payload", F.encode(line(), "UTF-8"))


def line() -> Column:
    """A record of the fenced log as the text that a writer sends, or a broken one."""
    fence = F.to_json(F.struct("record_type", "epoch", F.concat(F.lit("writer-"), "epoch").alias("owner")))
    ops = F.to_json(F.struct("record_type", "epoch", F.array(F.struct(*FIELDS)).alias("operations")))
    return F.when(F.col("record_type") == "fence", fence).when(F.col("record_type") == "operations", ops).otherwise(F.concat(F.lit("{poison-"), "sequence"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fenced log as it is stored: sequence and value."""
    return fenced_log(spark, sf_dir).select("sequence", F.decode("payload", "UTF-8").alias("value"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: us (microseconds), instance, is_error, value."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("user_id") % 2).alias("instance"),
        (F.col("event_type") == "error").cast("long").alias("is_error"), "value",
    )
