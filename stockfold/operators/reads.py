"""Read models: points, positional batches, ordered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS, MOST_INDEX, MOST_SCAN
from .ledger import balances, in_order, request, running_sum


def balance_point(ops: DataFrame, owner: str, sku: str) -> DataFrame:
    """One row; an unknown position is 0. The filter reaches the scan before the sum."""
    own = ops.where((F.col("owner_id") == owner) & (F.col("sku") == sku))
    one = own.agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("balance"))
    generation = ops.agg(F.max("sequence").alias("generation"))
    return one.crossJoin(generation).select(F.lit(owner).alias("owner_id"), F.lit(sku).alias("sku"), "balance", "generation")  # one row each


def balances_batch(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """Balances in request order; repeats stay, unknown positions are 0."""
    got = in_order(keys, balances(ops), ["owner_id", "sku"], "left")
    return got.select("pos", "owner_id", "sku", F.coalesce("balance", F.lit(0)).alias("balance")).orderBy("pos")


def owner_summary(ops: DataFrame, owners: DataFrame) -> DataFrame:
    """Total and positions (by SKU) of each asked owner; an unknown one has 0 and none."""
    own = ops.join(F.broadcast(request(owners).distinct()), "owner_id", "left_semi")
    list_ = F.array_sort(F.collect_list(F.struct("sku", "balance"))).alias("positions")
    sums = balances(own).groupBy("owner_id").agg(F.sum("balance").alias("total_balance"), F.count("*").alias("n_positions"), list_)
    none = F.array().cast("array<struct<sku:string,balance:bigint>>")
    return owners.join(sums, "owner_id", "left").select("owner_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("total_balance", "n_positions")), F.coalesce("positions", none).alias("positions"))


def owner_positions(ops: DataFrame, owner: str) -> DataFrame:
    return balances(ops.where(F.col("owner_id") == owner)).select("sku", "balance").orderBy("sku")


def operations_batch(history: DataFrame, ids: DataFrame) -> DataFrame:
    """Operations in request order; repeats stay, misses drop out."""
    return in_order(ids, history, ["operation_id"], "inner").select("pos", *FIELDS).orderBy("pos")


def operations_or_refusal(history: DataFrame, ids: DataFrame, checkpoint: int) -> DataFrame:
    """As ``operations_batch``, but any miss refuses the request: as unavailable
    while the history (with sequence) is behind ``checkpoint``, else as unknown."""
    got = operations_batch(history, ids)
    if got.count() < ids.count():  # MOST_BATCH rows at most
        require_complete(history, checkpoint)
        raise LookupError("some operations are unknown")
    return got


def first_found(keys: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """For each key (pos, operation_id) the operation in the first tier that has
    it, with the tier's number; all null if none has. Ids are unique in a tier."""
    both = None
    for k, tier in enumerate(tiers):
        rows = tier.select(*FIELDS, F.lit(k).alias("tier"))
        both = rows if both is None else both.unionByName(rows)
    hits = in_order(keys, both, ["operation_id"], "left").groupBy("pos", "operation_id")
    return hits.agg(F.min_by(F.struct("tier", *FIELDS[1:]), "tier").alias("r")).select("pos", "operation_id", "r.*").orderBy("pos")


def require_complete(history: DataFrame, checkpoint: int) -> None:
    """Refuses a read of a history that is behind the balances' checkpoint."""
    reached = history.agg(F.max("sequence")).first()[0]
    if reached is None or reached < checkpoint:
        raise RuntimeError(f"the history is at {reached}, behind the checkpoint {checkpoint}")


def page(history: DataFrame, by: Column | None = None, cursor: str | None = None, limit: int | None = None, checkpoint: int | None = None) -> DataFrame:
    """Operations after ``cursor`` in id order: of all (10,000 by default and at
    most) or, with ``by``, of an owner or SKU (100, 1,000 at most). With
    ``checkpoint`` a history that is behind it refuses the read."""
    if checkpoint is not None:
        require_complete(history, checkpoint)
    most = MOST_SCAN if by is None else MOST_INDEX
    limit = (MOST_SCAN if by is None else 100) if limit is None else limit
    if not 1 <= limit <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    rows = history if by is None else history.where(by)
    if cursor is not None:
        rows = rows.where(F.col("operation_id") > cursor)
    return rows.select(*FIELDS).orderBy("operation_id").limit(limit)


def next_cursor(rows: DataFrame, limit: int) -> DataFrame:
    """The last id if the page is full, else null; a full last page is followed by an empty one."""
    return rows.agg(F.count("*").alias("n"), F.when(F.count("*") == limit, F.max("operation_id")).alias("next_cursor"))


def pages(history: DataFrame, key: str, limit: int, prefix: int = 6) -> DataFrame:
    """All pages of every key at once: key, page, rows and the cursor after it.

    Ids are taken in stretches that share their first ``prefix`` characters, so a
    key with very many rows is numbered by several tasks."""
    ids = history.select(key, "operation_id")
    rows = running_sum(ids, [key], F.lit(1), "rn", F.substring("operation_id", 1, prefix), "operation_id")
    numbered = rows.withColumn("page", F.floor((F.col("rn") - 1) / limit).cast("long"))
    return numbered.groupBy(key, "page").agg(F.count("*").alias("n"), F.when(F.count("*") == limit, F.max("operation_id")).alias("next_cursor"))
