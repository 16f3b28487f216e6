"""Operators on operations: first-wins, conflicts, balances, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import same
from ..schema import FIELDS, MOST_BATCH, PAYLOAD


#: Sequences of a stretch of running sums.
SPAN = 1 << 20


def first_wins(ops: DataFrame, *order: str | Column) -> DataFrame:
    """The first row of each id. ``min_by`` keeps one row an id and task before
    the exchange, which a window would not."""
    rest = [n for n in ops.columns if n != "operation_id"]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return ops.groupBy("operation_id").agg(best).select("operation_id", "r.*")


def last_wins(ops: DataFrame, *order: str | Column) -> DataFrame:
    rest = [n for n in ops.columns if n != "operation_id"]
    return ops.groupBy("operation_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("operation_id", "r.*")


def conflicts(ops: DataFrame) -> DataFrame:
    """Ids with several payloads. Payloads are made distinct first, so that a
    much repeated id is small before the last exchange."""
    return ops.select("operation_id", *PAYLOAD).distinct().groupBy("operation_id").agg(F.count("*").alias("n_payloads")).where("n_payloads > 1")


def balances(ops: DataFrame) -> DataFrame:
    """Sum of deltas by position; positions at zero stay."""
    return ops.groupBy("owner_id", "sku").agg(F.sum("delta").alias("balance"))


def snapshot_plus_tail(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """A snapshot's balances and the operations after it."""
    both = snapshot.select("owner_id", "sku", F.col("balance").alias("delta")).unionByName(tail.select("owner_id", "sku", "delta"))
    return balances(both)


def running_sum(rows: DataFrame, keys: list[str], value: Column, out: str, stretch: Column, *order: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows of the same keys up to each
    row. ``stretch`` must grow with the order: sums are taken within stretches,
    and the stretches' own sums, one row each, are carried forward. So the rows of
    a hot key are in as many tasks as it has stretches."""
    rows = rows.withColumn("_stretch", stretch)
    own = [*keys, "_stretch"]
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*own).agg(F.sum(value).alias("_top")).withColumn("_carried", F.coalesce(F.sum("_top").over(before), F.lit(0))).drop("_top")
    tops = tops.toDF(*(f"_k{k}" for k in range(len(own))), "_carried")
    inside = F.sum(value).over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    match = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"_k{k}")) for k, n in enumerate(own)))
    names = [n for n in rows.columns if n != "_stretch"]
    return rows.withColumn(out, inside).join(tops, match).withColumn(out, F.col(out) + F.col("_carried")).select(*names, out)


def running_balances(ops: DataFrame, *order: str, span: int = SPAN, ends: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Adds balance, the position's after each row; ``order`` begins with a
    number. If its least and greatest value (``ends``) are known to be in one
    stretch, there is nothing to carry and one window does."""
    if ends and (ends[0] is None or ends[0] // span == ends[1] // span):
        w = Window.partitionBy("owner_id", "sku").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ops.withColumn("balance", F.sum("delta").over(w))
    return running_sum(ops, ["owner_id", "sku"], F.col("delta"), "balance", F.floor(F.col(order[0]) / span), *order)


def fresh(ops: DataFrame, seen: DataFrame) -> DataFrame:
    return ops.join(seen.select("operation_id"), "operation_id", "left_anti")


def duplicates(ops: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose id was seen with the same payload."""
    a, b = ops.alias("a"), seen.select("operation_id", *PAYLOAD).alias("b")
    return a.join(b, (F.col("a.operation_id") == F.col("b.operation_id")) & same("a", "b", PAYLOAD), "left_semi")


def stored_conflicts(ops: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose id was seen with another payload."""
    a, b = ops.alias("a"), seen.select("operation_id", *PAYLOAD).alias("b")
    return a.join(b, (F.col("a.operation_id") == F.col("b.operation_id")) & ~same("a", "b", PAYLOAD), "left_semi")


def batch_conflicts(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """All ids for which a request batch has to be rejected as a whole."""
    return conflicts(batch).select("operation_id").unionByName(stored_conflicts(batch, seen).select("operation_id")).distinct()


def classify(batch: DataFrame, seen: DataFrame, state: DataFrame) -> DataFrame:
    """Results of one accepted request batch (pos, operation) against the
    operations seen and the published balances. Duplicates, of earlier batches
    or within this one, report the balance from before the batch; applied rows
    the running one. A batch has MOST_BATCH rows at most."""
    return classify_all(batch.withColumn("batch", F.lit(0).cast("long")), seen, state).drop("batch")


def batch_conflicts_of_all(ops: DataFrame) -> DataFrame:
    """For every batch of a ledger (batch, operation) the ids for which it has
    to be rejected, if all rows of the batches before it are seen: those with
    several payloads up to and with the batch."""
    w = Window.partitionBy("operation_id").orderBy("batch").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ops.select("batch", "operation_id", F.struct(*PAYLOAD).alias("_p")).distinct()
    return rows.withColumn("_low", F.min("_p").over(w)).withColumn("_high", F.max("_p").over(w)).where("_low <> _high").select("batch", "operation_id").distinct()


def classify_all(ops: DataFrame, seen: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """As ``classify``, for all batches of a ledger (batch, pos, operation) at
    once, each against all batches before it (and ``seen`` and ``state``, if
    given, before them all). All batches are accepted ones."""
    first = F.row_number().over(Window.partitionBy("operation_id").orderBy("batch", "pos")) == 1
    rows = ops.withColumn("_first", first)
    if seen is not None:
        rows = rows.join(seen.select("operation_id").distinct().withColumn("_seen", F.lit(True)), "operation_id", "left")
        rows = rows.withColumn("_first", F.col("_first") & F.col("_seen").isNull())
    rows = rows.withColumn("status", F.when(F.col("_first"), "applied").otherwise("duplicate"))
    start = F.lit(0)
    if state is not None:
        rows = rows.join(state.select("owner_id", "sku", F.col("balance").alias("_start")), ["owner_id", "sku"], "left")
        start = F.coalesce("_start", F.lit(0))
    delta = F.when(F.col("status") == "applied", F.col("delta")).otherwise(0)
    w = Window.partitionBy("owner_id", "sku").orderBy("batch")
    before = start + F.coalesce(F.sum(delta).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = F.sum(delta).over(Window.partitionBy("owner_id", "sku", "batch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    balance = before + F.when(F.col("status") == "applied", added).otherwise(0)
    return rows.withColumn("balance", balance).select("batch", "pos", *FIELDS, "status", "balance")


def request(keys: DataFrame) -> DataFrame:
    """Keys of a request, to be broadcast: 1 to MOST_BATCH rows, which is checked."""
    n = keys.limit(MOST_BATCH + 1).count()
    if not 1 <= n <= MOST_BATCH:
        raise ValueError(f"a request has 1 to {MOST_BATCH} keys")
    return keys


def in_order(keys: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Positional lookup of a request's ``keys`` (pos, key columns)."""
    request(keys)
    if how == "inner":
        return right.join(F.broadcast(keys), on, "inner")
    found = right.join(F.broadcast(keys.select(*on).distinct()), on, "left_semi")
    return keys.join(found, on, "left")


def in_stores(keys: DataFrame, stores: list[DataFrame]) -> DataFrame:
    """Whether any store has an id: ``keys`` (pos, operation_id) with found."""
    hits = [x.join(F.broadcast(request(keys).select("operation_id").distinct()), "operation_id", "left_semi").select("operation_id") for x in stores]
    some = reduce(DataFrame.unionByName, hits).groupBy("operation_id").agg(F.lit(True).alias("_hit"))
    return keys.join(some, "operation_id", "left").select("pos", "operation_id", F.coalesce("_hit", F.lit(False)).alias("found"))
