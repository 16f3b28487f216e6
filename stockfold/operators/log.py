"""The write side of the log: messages with an id of their own content, fences,
and appending without a second copy of a message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS
from .ledger import running_sum

SPAN = 1 << 16


def messages(ops: DataFrame, epoch: int) -> DataFrame:
    """One operations record for each batch of (batch, pos, operation): batch,
    value and message_id, a digest of the value; batches are never empty."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", *FIELDS))), lambda o: F.struct(*(o[n].alias(n) for n in FIELDS)))
    body = F.struct(F.lit("operations").alias("record_type"), F.lit(epoch).alias("epoch"), F.col("operations"))
    made = ops.groupBy("batch").agg(rows.alias("operations")).select("batch", F.to_json(body).alias("value"))
    return made.withColumn("message_id", F.concat(F.lit("operations-"), F.sha2(F.encode("value", "UTF-8"), 256)))


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """What ``new`` (batch, value, message_id) adds to ``log`` (sequence, value,
    message_id): messages that the log has, or that came before, are left out;
    the others follow its last sequence in the order of their batches. Numbers
    are given within stretches of batches and carried forward."""
    once = new.groupBy("message_id").agg(F.min_by(F.struct("batch", "value"), "batch").alias("r")).select("message_id", "r.*")
    fresh = once.join(log.select("message_id"), "message_id", "left_anti")
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))
    rows = running_sum(fresh, [], F.lit(1), "n", F.floor(F.col("batch") / SPAN), "batch", "message_id")
    return rows.crossJoin(last).select((F.col("last") + F.col("n")).alias("sequence"), "value", "message_id")  # last: one row


def fence(log: DataFrame, epoch: int, owner: str) -> DataFrame:
    """The record that activates a writer's epoch, after the log's last sequence."""
    body = F.struct(F.lit("fence").alias("record_type"), F.lit(epoch).alias("epoch"), F.lit(owner).alias("owner"))
    last = log.agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("sequence"))
    return last.select("sequence", F.to_json(body).alias("value"), F.concat(F.lit("fence-"), "sequence").alias("message_id"))
