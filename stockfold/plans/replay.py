"""Replay of the fenced log.

A log is a DataFrame of records: sequence, record_type (fence, operations or
poison), epoch, payload, and either ``operations`` (an array, as it is decoded)
or the fields of one operation. ``flat`` gives the second form with ``pos``, the
place in the record; all functions here take both. Records are ordered by
(sequence, pos).

The active epoch is the greatest epoch of a fence so far. Fences are few: their
intervals, cut at stretches of the sequence, are broadcast once their number has
been checked, so the log itself is not exchanged. A log with more of them takes
two windows, within stretches and over the stretches' own maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ledger import first_wins, last_wins, running_balances
from ..schema import FIELDS, PAYLOAD

SPAN = 1 << 16
#: Fences that are broadcast at most; also the number of stretches that they are cut at.
MOST_FENCES = 100_000
ORDER = ("sequence", "pos")


def flat(log: DataFrame) -> DataFrame:
    """One row for each operation; fences and poison records, and operation
    records without operations, are one row without any. The payload, which is
    that of a whole record, is dropped."""
    log = log.drop("payload")
    if "operations" in log.columns:
        log = log.select(*(n for n in log.columns if n != "operations"), F.posexplode_outer("operations").alias("pos", "_o")).select("*", "_o.*").drop("_o")
    return log.withColumn("pos", F.coalesce(F.col("pos") if "pos" in log.columns else F.lit(None), F.lit(0)))


FENCE = "record_type = 'fence' and epoch is not null"


def extent(log: DataFrame) -> tuple[int, int | None, int | None]:
    """Fences, first and last sequence."""
    return tuple(log.agg(F.count_if(F.expr(FENCE)), F.min("sequence"), F.max("sequence")).first())


def active_epochs(log: DataFrame, seed: int = 0, span: int = SPAN, most_fences: int = MOST_FENCES, known: tuple | None = None) -> DataFrame:
    """Adds active: the greatest epoch of a fence up to each record, ``seed`` at
    least. ``known`` is the log's ``extent``, if it has been taken."""
    n, low, high = known or extent(log)
    if not n:
        return log.withColumn("active", F.lit(seed).cast("long"))
    if n > most_fences:
        return by_stretches(log, seed, span)
    span = max(span, (high - low) // most_fences + 1)
    own = log.where(FENCE).groupBy("sequence").agg(F.max("epoch").alias("epoch"))
    upto = Window.orderBy("sequence")  # of most_fences rows at most
    own = own.select(
        F.col("sequence").alias("_from"), F.lead("sequence", 1, high + 1).over(upto).alias("_to"),
        F.greatest(F.lit(seed).cast("long"), F.max("epoch").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("active"),
    )
    before = own.agg(F.min("_from").alias("_to")).select(F.lit(low).alias("_from"), "_to", F.lit(seed).cast("long").alias("active"))
    stretch = lambda c: F.floor(c / span).cast("long")
    cut = own.unionByName(before).where("_from < _to").withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.col("_to") - 1))))
    inside = (F.col("_stretch") == stretch(F.col("sequence"))) & (F.col("sequence") >= F.col("_from")) & (F.col("sequence") < F.col("_to"))
    return log.join(F.broadcast(cut), inside).drop("_from", "_to", "_stretch")


def by_stretches(log: DataFrame, seed: int = 0, span: int = SPAN) -> DataFrame:
    """``active_epochs`` for a log with any number of fences."""
    fence = F.when(F.col("record_type") == "fence", F.col("epoch"))
    rows = log.withColumn("_span", F.floor(F.col("sequence") / span).cast("long"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("_span").agg(F.max(fence).alias("_top"))
    tops = tops.select("_span", F.max("_top").over(before).alias("_carried"))
    own = F.max(fence).over(Window.partitionBy("_span").orderBy("sequence").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # greatest() passes over nulls
    return rows.withColumn("_own", own).join(tops, "_span").withColumn("active", F.greatest(F.lit(seed).cast("long"), "_own", "_carried")).drop("_span", "_own", "_carried")


def fenced(log: DataFrame, seed: int = 0, known: tuple | None = None) -> DataFrame:
    """The operations of the writer that is active, flat."""
    return flat(active_epochs(log, seed, known=known).where("record_type = 'operations' and epoch = active")).where("operation_id is not null")


def stale(log: DataFrame, seed: int = 0) -> DataFrame:
    """Operation records of any other epoch, below or above the active one."""
    return active_epochs(log, seed).where("record_type = 'operations' and epoch <> active")


def conflicting_rows(log: DataFrame, seed: int = 0) -> DataFrame:
    """Later fenced rows whose payload differs from the first of their id; they have no effect."""
    rows = fenced(log, seed)
    # an id with one payload only has no such rows: payloads are reduced before the join
    pay = F.struct(*PAYLOAD)
    first = rows.groupBy("operation_id").agg(F.min_by(pay, F.struct(*ORDER)).alias("_p"), F.min(pay).alias("_low"), F.max(pay).alias("_high")).where("_low <> _high")
    return rows.join(first.select("operation_id", "_p"), "operation_id").where(pay != F.col("_p")).drop("_p")


def with_payload(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(sequence, payload) of the records of some operations."""
    return log.select("sequence", "payload").join(rows.select("sequence").distinct(), "sequence", "left_semi")


def dead_letters(log: DataFrame, stream: str = "ledger", seed: int = 0, conflicts: bool = False) -> DataFrame:
    """Poison and stale records, and with ``conflicts`` those that reuse an id
    for something else: source_stream, source_sequence, reason and payload, one
    row for each (source_stream, source_sequence) however often it came."""
    rows = active_epochs(log, seed).where("record_type = 'poison' or (record_type = 'operations' and epoch <> active)")
    stale_ = F.format_string("writer epoch %d rejected; active epoch is %d", "epoch", "active")
    reason = F.when(F.col("record_type") == "poison", "poison").otherwise(stale_)
    rows = rows.select("sequence", reason.alias("reason"), "payload")
    if conflicts:
        rows = rows.unionByName(with_payload(conflicting_rows(log, seed), log).withColumn("reason", F.lit("conflict")))
    one = rows.groupBy("sequence").agg(F.min(F.struct("reason", "payload")).alias("r"))
    return one.select(F.lit(stream).alias("source_stream"), F.col("sequence").alias("source_sequence"), "r.*")


def replay(log: DataFrame, seed: int = 0) -> DataFrame:
    """Applied operations with running balances: fenced, first of each id, then
    summed. An id that comes again with another payload has no effect here (see
    ``conflicting_rows``)."""
    known = extent(log)
    rows = first_wins(fenced(log, seed, known).select(*ORDER, *FIELDS), *ORDER)
    return running_balances(rows, *ORDER, ends=known[1:])


def history(log: DataFrame, seed: int = 0) -> DataFrame:
    """The history table: fenced operations by id, the last write of each."""
    return last_wins(fenced(log, seed).select(*ORDER, *FIELDS), *ORDER)
