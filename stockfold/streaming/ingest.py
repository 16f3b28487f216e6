"""Streaming ingest of request batches, and the log's live and history tails.

Each micro-batch reads the versions of its store before its own and writes its
own, so running it again after a failure, before or after the commit, changes
nothing. What was seen is read once in a micro-batch, so its cost is shared by
all requests or records of the micro-batch: raise ``files`` with the history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import reason
from ..operators.ledger import balances, classify_all, first_wins, last_wins, snapshot_plus_tail
from ..plans import replay
from ..schema import FIELDS, MOST_BATCH, PAYLOAD
from ..sources.files import decode
from .store import OPS, TABLES, Store

#: Rows of contested ids that are settled on the driver; beyond that the requests are taken in smaller groups.
MOST_CONTESTED = 100_000
#: Micro-batches between two compactions.
COMPACT_EVERY = 16


def refusals(rows: DataFrame) -> DataFrame:
    """(batch, operation_id, reason) of requests that fail by themselves: too
    large, or with an invalid operation (the first one is named)."""
    rows = rows.withColumn("why", reason())
    sums = rows.groupBy("batch").agg(F.count("*").alias("n"), F.min(F.when(F.col("why").isNotNull(), F.struct("pos", "operation_id", "why"))).alias("r"))
    large = F.col("n") > MOST_BATCH
    own = F.when(large, f"batch must contain 1..={MOST_BATCH} operations").otherwise(F.col("r.why"))
    return sums.where(large | F.col("r").isNotNull()).select("batch", F.when(~large, F.col("r.operation_id")).alias("operation_id"), own.alias("reason"))


def contested(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose id has several payloads among the requests and what was seen
    (batch null): only their requests' fates depend on each other."""
    pay = F.struct(*PAYLOAD)
    known = seen.join(rows.select("operation_id").distinct(), "operation_id", "left_semi")
    both = rows.select("batch", "operation_id", pay.alias("p")).unionByName(known.select(F.lit(None).cast("long").alias("batch"), "operation_id", pay.alias("p"))).distinct()
    several = both.groupBy("operation_id").agg(F.min("p").alias("low"), F.max("p").alias("high")).where("low <> high").select("operation_id")
    return both.join(several, "operation_id", "left_semi")


def settle(rows: list) -> dict[int, str]:
    """Requests (by number) that are refused, with the id: in their order, each
    against what those before it left."""
    known = {r.operation_id: r.p for r in rows if r.batch is None}
    by: dict[int, list] = {}
    for r in rows:
        if r.batch is not None:
            by.setdefault(r.batch, []).append(r)
    out = {}
    for batch in sorted(by):
        own: dict = {}
        clash = [r.operation_id for r in sorted(by[batch], key=lambda r: r.operation_id) if known.get(r.operation_id, own.setdefault(r.operation_id, r.p)) != r.p]
        if clash:
            out[batch] = clash[0]
        else:
            known.update(own)
    return out


def apply_requests(store: Store, rows: DataFrame, version: int, failpoint: Callable[[str], None] = lambda step: None, most_contested: int = MOST_CONTESTED) -> None:
    """Requests (batch, pos, operation) in the order of their numbers, each all
    or nothing. A request whose number was already answered is a new delivery of
    it and applies nothing, as all its operations are known."""
    spark = store.spark
    rows = rows.select("batch", F.col("pos").cast("int").alias("pos"), *FIELDS).persist()
    try:
        if rows.isEmpty():
            return
        bad = refusals(rows).persist()
        valid = rows.join(bad.select("batch"), "batch", "left_anti")
        seen, before = store.seen(version), store.read("balances", version)
        fight = contested(valid, seen)
        if fight.limit(most_contested + 1).count() > most_contested:
            raise RuntimeError(f"over {most_contested} rows of contested ids in one micro-batch: lower the number of files in a trigger")
        lost = spark.createDataFrame([(b, i, "conflict") for b, i in settle(fight.collect()).items()], TABLES["rejected"])
        got = classify_all(valid.join(lost.select("batch"), "batch", "left_anti"), seen, before)
        store.write("rejected", version, bad.unionByName(lost))
        store.write("results", version, got)
        results = spark.read.schema(TABLES["results"]).parquet(f"{store.root}/results/v={version}")
        failpoint("results")
        applied = results.where("status = 'applied'")
        store.write("seen", version, applied, "operation_id")
        store.write("balances", version, snapshot_plus_tail(before, applied))
        last = rows.agg(F.max("batch")).first()[0]
        failpoint("commit")
        sequence, epoch = store.progress(version)
        store.commit(version, max(sequence, last), epoch)
        bad.unpersist()
    finally:
        rows.unpersist()
    if version % COMPACT_EVERY == COMPACT_EVERY - 1:
        store.compact("seen", version, "operation_id")


def ingest(spark: SparkSession, source: str, store: Store, checkpoint: str, files: int = 64, failpoint: Callable[[str], None] = lambda step: None) -> StreamingQuery:
    """Reads request batches from Parquet files of (batch, pos, operation)."""
    stream = spark.readStream.schema(f"batch long, pos int, {OPS}").option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(lambda rows, version: apply_requests(store, rows, version, failpoint))
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_records(store: Store, lines: DataFrame, version: int) -> tuple[DataFrame, int, int]:
    """The records after the store's position, once each, with that position."""
    sequence, epoch = store.progress(version)
    rows = lines.where(F.col("sequence") > sequence).groupBy("sequence").agg(F.min("record").alias("record"))
    return decode(rows, "record").drop("record"), sequence, epoch


def position(log: DataFrame, sequence: int, epoch: int) -> tuple[int, int]:
    last, top = log.agg(F.max("sequence"), F.max(F.when(F.col("record_type") == "fence", F.col("epoch")))).first()
    return max(sequence, last or 0), max(epoch, top or 0)


def apply_log(store: Store, lines: DataFrame, version: int, stream: str = "ledger", failpoint: Callable[[str], None] = lambda step: None) -> None:
    """Records (sequence, record) of the live log: balances of what is fenced
    and new, dead letters of poison, stale writers and reused ids, and the
    position, in one version."""
    log, sequence, epoch = new_records(store, lines, version)
    log = log.persist()
    try:
        if log.isEmpty():
            return
        seen, before = store.seen(version), store.read("balances", version)
        ops = replay.fenced(log, epoch).select(*replay.ORDER, *FIELDS)
        # what was seen comes before all that is new
        old = seen.join(ops.select("operation_id").distinct(), "operation_id", "left_semi")
        both = old.select(F.lit(-1).cast("long").alias("sequence"), F.lit(0).alias("pos"), *FIELDS).unionByName(ops)
        first = first_wins(both, *replay.ORDER)
        store.write("seen", version, first.where("sequence >= 0"), "operation_id")
        failpoint("seen")
        reused = ops.join(first.select("operation_id", F.struct(*PAYLOAD).alias("p")), "operation_id").where(F.struct(*PAYLOAD) != F.col("p"))
        reused = replay.with_payload(reused, log).select(F.lit(stream).alias("source_stream"), F.col("sequence").alias("source_sequence"), F.lit("conflict").alias("reason"), "payload")
        store.write("dead", version, replay.dead_letters(log, stream, epoch).unionByName(reused))
        fresh = spark_read(store, "seen", version)
        store.write("balances", version, snapshot_plus_tail(before, fresh))
        failpoint("commit")
        store.commit(version, *position(log, sequence, epoch))
    finally:
        log.unpersist()
    if version % COMPACT_EVERY == COMPACT_EVERY - 1:
        store.compact("seen", version, "operation_id")


def spark_read(store: Store, kind: str, version: int) -> DataFrame:
    """What this version has just written."""
    return store.spark.read.schema(TABLES[kind]).parquet(f"{store.root}/{kind}/v={version}")


def apply_history(store: Store, lines: DataFrame, version: int) -> None:
    """The history's own tail, with its own position: fenced operations, the
    last write of an id; stale records are passed over."""
    log, sequence, epoch = new_records(store, lines, version)
    log = log.persist()
    try:
        if log.isEmpty():
            return
        store.write("history", version, last_wins(replay.fenced(log, epoch).select(*replay.ORDER, *FIELDS), *replay.ORDER), "operation_id")
        store.commit(version, *position(log, sequence, epoch))
    finally:
        log.unpersist()


def history(store: Store) -> DataFrame:
    """The history table as of the last version."""
    return last_wins(store.read("history"), *replay.ORDER)


def tail(spark: SparkSession, source: str, store: Store, checkpoint: str, apply: Callable[..., None] = apply_log, files: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Follows log lines ``{"sequence": n, "record": "..."}`` with ``apply``
    (``apply_log`` or ``apply_history``); ``trigger`` as Spark's, by default all
    that is there. Files must come in the order of their sequences."""
    stream = spark.readStream.schema("sequence long, record string").option("maxFilesPerTrigger", files).json(source)
    query = stream.writeStream.foreachBatch(lambda lines, version: apply(store, lines, version))
    return query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rebuild(store: Store, log: DataFrame) -> None:
    """A store anew from a whole decoded log, as version 0: for a cold start
    without a snapshot, after damage (``Store.set_aside``), or in a new format."""
    applied = replay.replay(log)
    store.write("seen", 0, applied.repartitionByRange("operation_id"), "operation_id")
    store.write("balances", 0, balances(spark_read(store, "seen", 0)))
    store.write("dead", 0, replay.dead_letters(log, conflicts=True))
    kept = replay.history(log).repartitionByRange("operation_id")
    store.write("history", 0, kept, "operation_id")
    store.commit(0, *position(log, 0, 0))
