"""Monitoring: percentiles, rates, alerts, exposition.

Series are few and long. Nothing here takes a whole series in one task: it is
cut into stretches of time, what passes from one stretch to the next is one row
a stretch, and only those rows are taken in order by series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ledger import running_sum

#: Microseconds of a stretch: six hours.
SPAN = 6 * 3600 * 1_000_000


def stretch(us: str, span: int = SPAN) -> Column:
    return F.floor(F.col(us) / span).cast("long")


def percentiles(rows: DataFrame, key: str, value: str, points: tuple[int, ...] = (50, 95, 99), parts: int = 64) -> DataFrame:
    """The element at floor((n - 1) * p / 100) of each key's sorted values; an
    exact rank, without a list of the values. Equal values are counted first.
    Counts are then dealt by the value's range (``parts`` of equal width between
    the key's least and greatest value) and summed by range; only the range sums
    of a key, ``parts`` rows, meet in one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    ends = counts.groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("c").alias("n"))
    same = F.col(key).eqNullSafe(F.col("_k"))
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0))
    part = F.least(F.coalesce(F.floor((F.col(value) - F.col("_low")) * parts / width), F.lit(0)), F.lit(parts - 1)).cast("int")
    ranged = counts.join(ends.withColumnRenamed(key, "_k"), same).drop("_k").withColumn("_part", part)
    counted = running_sum(ranged, [key], F.col("c"), "upto", F.col("_part"), value)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p / 100), F.col(value))).alias(f"p{p}")
    return counted.groupBy(key).agg(*(at(p) for p in points))


def increases(samples: DataFrame, value: str, key: str, us: str, tie: str, span: int = SPAN) -> DataFrame:
    """Adds increase: growth of a counter since its last sample; after a reset,
    its value. The last value of a stretch is carried to the next one that has samples."""
    rows = samples.withColumn("_s", stretch(us, span))
    lasts = rows.groupBy(key, "_s").agg(F.max_by(value, F.struct(us, tie)).alias("_last"))
    lasts = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_s")))
    lasts = lasts.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), "_carried")
    rows = rows.join(lasts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t"))).drop("_k", "_t")
    before = F.coalesce(F.lag(value).over(Window.partitionBy(key, "_s").orderBy(us, tie)), F.col("_carried"))
    grown = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return rows.withColumn("increase", grown).drop("_carried", "_s")


def rates(samples: DataFrame, value: str, key: str, us: str, tie: str, seconds: int = 60, span: int = SPAN) -> DataFrame:
    """Adds rate: increase a second over the last ``seconds``, without
    extrapolation. The last ``seconds`` of a stretch are seen by the next one too."""
    back = seconds * 1_000_000
    own = stretch(us, span)
    after = F.when(F.col(us) + back >= (own + 1) * span, F.array(own, own + 1)).otherwise(F.array(own))
    rows = increases(samples, value, key, us, tie, span).withColumn("_s", F.explode(after))
    w = Window.partitionBy(key, "_s").orderBy(us).rangeBetween(-back, 0)
    return rows.withColumn("rate", F.sum("increase").over(w) / seconds).where(F.col("_s") == own).drop("_s")


def runs(samples: DataFrame, keys: list[str], us: str, tie: str, condition: Column, span: int = SPAN) -> DataFrame:
    """Stretches of a series in which a condition holds without a break: keys,
    start_us, end_us and samples. Runs that touch an edge of a stretch of time
    are put together with those of the next."""
    own = [*keys, "_s"]
    rows = samples.withColumn("_on", F.coalesce(condition, F.lit(False))).withColumn("_s", stretch(us, span))
    off = F.when(F.col("_on"), 0).otherwise(1)
    island = F.sum(off).over(Window.partitionBy(*own).orderBy(us, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_island", island).withColumn("_offs", F.sum(off).over(Window.partitionBy(*own)))
    spans = rows.groupBy(*own, "_island", "_offs").agg(
        F.min(F.when(F.col("_on"), F.col(us))).alias("start_us"), F.max(F.when(F.col("_on"), F.col(us))).alias("end_us"), F.count_if("_on").alias("n"))
    spans = spans.where("n > 0").withColumn("_first", F.col("_island") == 0).withColumn("_last", F.col("_island") == F.col("_offs"))
    inner = spans.where("not _first and not _last").select(*keys, "start_us", "end_us", "n")
    numbers = rows.groupBy(*own).agg(F.lit(1).alias("_one")).withColumn("_number", F.row_number().over(Window.partitionBy(*keys).orderBy("_s"))).drop("_one")
    numbers = numbers.toDF(*(f"_k{k}" for k in range(len(own))), "_number")
    match = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_k{k}")) for k, n in enumerate(own)))
    edge = spans.where("_first or _last").join(numbers, match).select(*keys, "start_us", "end_us", "n", "_first", "_last", "_number", "_island")
    inorder = Window.partitionBy(*keys).orderBy("_number", "_island")
    goes_on = F.col("_first") & F.coalesce(F.lag("_last").over(inorder) & (F.lag("_number").over(inorder) == F.col("_number") - 1), F.lit(False))
    group = F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(inorder.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = edge.withColumn("_goes_on", goes_on).withColumn("_group", group).groupBy(*keys, "_group").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
    return inner.unionByName(joined.select(*keys, "start_us", "end_us", "n"))


def alerts(samples: DataFrame, name: str, key: str, us: str, tie: str, condition: Column, hold_seconds: float, span: int = SPAN) -> DataFrame:
    """Runs of a condition that are held for so long: alert, key, first and last moment, samples."""
    held = F.col("end_us") - F.col("start_us") >= int(hold_seconds * 1_000_000)
    return runs(samples, [key], us, tie, condition, span).where(held).select(F.lit(name).alias("alert"), key, "start_us", "end_us", "n")


#: Fixed values: (alert, aggregate over the instances at one moment; null: each
#: instance by itself, condition on it as x, hold in seconds).
RULES = [
    ("NodeDown", None, "up", "x = 0", 15), ("QuorumUnavailable", "max", "quorum_available", "x = 0", 5), ("NoWriter", "sum", "writer_lease_owned", "x = 0", 10),
    ("MultipleWriters", "sum", "writer_lease_owned", "x > 1", 2), ("ReplicationLag", "max", "replication_lag", "x > 5", 15), ("HistoryBackfillLag", "max", "history_lag", "x > 0", 300),
    ("UnavailableResponses", "sum", "unavailable_rate", "x > 0", 30), ("HighMemory", "max", "process_memory_bytes", "x > 1073741824", 300),
    ("LogNearCapacity", "max", "try_divide(stream_bytes, stream_max_bytes)", "x > 0.80", 60), ("LogCritical", "max", "try_divide(stream_bytes, stream_max_bytes)", "x > 0.95", 10),
]
METRICS = ("up", "quorum_available", "writer_lease_owned", "replication_lag", "history_lag", "unavailable_rate", "process_memory_bytes", "stream_bytes", "stream_max_bytes")


def rule_alerts(metrics: DataFrame, key: str = "instance", us: str = "us", span: int = SPAN) -> DataFrame:
    """All rules over metric rows (key, us, one column a metric; one row for an
    instance and moment): alert, key (null where the rule is about all instances
    together), start_us, end_us, n. Metrics that are missing, as columns or as
    nulls, raise no alert. A moment is what samples of all instances have in
    common; if instances are sampled apart, round ``us`` to the interval first.

    All rules take one pass: each moment gives one row for each rule and series."""
    have = lambda e: all(m in metrics.columns for m in METRICS if m in e)
    rules = [r for r in RULES if have(r[2])]
    by_moment = [(name, f"{how}({expr})", condition, hold) for name, how, expr, condition, hold in rules if how]
    alone = [(name, expr, condition, hold) for name, how, expr, condition, hold in rules if not how]
    row = lambda name, x, condition, hold: F.struct(F.lit(name).alias("alert"), F.expr(condition.replace("x", x)).alias("on"), F.lit(hold * 1_000_000).cast("long").alias("hold"))
    kind, parts = metrics.schema[key].dataType, []
    if by_moment:
        merged = metrics.groupBy(us).agg(*(F.expr(x).alias(f"_{k}") for k, (_, x, _, _) in enumerate(by_moment)))
        each = F.explode(F.array(*(row(name, f"_{k}", condition, hold) for k, (name, _, condition, hold) in enumerate(by_moment))))
        parts.append(merged.select(F.lit(None).cast(kind).alias(key), us, each.alias("r")))
    if alone:
        each = F.explode(F.array(*(row(name, expr, condition, hold) for name, expr, condition, hold in alone)))
        parts.append(metrics.select(key, us, each.alias("r")))
    if not parts:
        return metrics.sparkSession.createDataFrame([], f"alert string, {key} {kind.simpleString()}, start_us long, end_us long, n long")
    series = reduce(DataFrame.unionByName, parts).select(key, us, "r.*")
    found = runs(series, ["alert", key, "hold"], us, us, F.col("on"), span)
    return found.where(F.col("end_us") - F.col("start_us") >= F.col("hold")).select("alert", key, "start_us", "end_us", "n")


#: Metrics that are counters; all others are gauges.
COUNTERS = ("operations_applied_total", "operations_duplicate_total", "conflicts_total", "unavailable_total", "pipeline_batch_requests_total", "pipeline_operations_total")


def exposition(metrics: DataFrame, prefix: str = "warehouse_") -> DataFrame:
    """Metric rows (metric, value) as text lines, each after its TYPE line: value
    (two lines); ``parse`` reads them back."""
    kind = F.when(F.col("metric").isin(*COUNTERS) | F.col("metric").endswith("_seconds_total"), "counter").otherwise("gauge")
    text = F.when(F.col("metric").endswith("_seconds_total"), F.format_string("%.9f", F.col("value").cast("double"))).otherwise(F.col("value").cast("long").cast("string"))
    return metrics.select(F.format_string(f"# TYPE {prefix}%s %s\n{prefix}%s %s", "metric", kind, "metric", text).alias("value"))


def parse(lines: DataFrame, prefix: str = "warehouse_") -> DataFrame:
    """Metric rows of exposition text, of one or more lines a row; comments and other lines go."""
    pattern = rf"^{prefix}(\S+)\s+([0-9.eE+-]+)$"
    rows = lines.select(F.explode(F.split("value", "\r?\n")).alias("value")).where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("metric"), F.regexp_extract("value", pattern, 2).cast("double").alias("value"))


def readiness(checkpoint: DataFrame, log: DataFrame, most_lag: int = 0) -> DataFrame:
    """Whether a reader has caught up: checkpoint (sequence) against the log's
    end, both one number, with the lag (never below 0)."""
    done, last = checkpoint.agg(F.max("sequence").alias("checkpoint")), log.agg(F.max("sequence").alias("last_sequence"))
    lag = F.greatest(F.coalesce("last_sequence", F.lit(0)) - F.coalesce("checkpoint", F.lit(0)), F.lit(0))
    return done.crossJoin(last).withColumn("lag", lag).withColumn("ready", F.col("lag") <= most_lag)  # one row each
