"""Uniform shuffle into shards of exact sizes by a hypergeometric communication
matrix.

The rows that each input partition sends to each cell (a stretch of a shard's
slots) are drawn from the multivariate hypergeometric law, whose row sums are
the partitions' counts and whose column sums are the cells' sizes. Partitions
permute their rows to fill their part of the draw, rows are exchanged by cell,
and cells permute again. The law is ``rows``: shard sizes are at most one apart.

The matrix is never held: each task draws its own row by descending a binary
tree over partitions, seeded by node, in which every task draws the same splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import scratch, table

SHARDS = 16
#: Slots of a cell at most: what one task permutes.
CELL = 1 << 16
#: Input partitions at most: the vector of their counts is broadcast.
MOST_PARTITIONS = 100_000


def cells(total: int, shards: int, cell: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, slots) of every cell."""
    out = []
    for s in range(shards):
        size = total // shards + (s < total % shards)
        n = max(1, -(-size // cell))
        cuts = [size * k // n for k in range(n + 1)]
        out += [(s, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def split(rng: np.random.Generator, colors: np.ndarray, sample: int) -> np.ndarray:
    """How many of each color are among ``sample`` things drawn without return,
    of any number of things. Each thing is first taken with one probability, on
    its own, so the binomials do not depend on each other; then as many as are
    too few or too many, drawn from the rest or from the taken, come or go. As
    no step prefers a thing, every set of ``sample`` things is equally likely,
    which is the multivariate hypergeometric law."""
    total = int(colors.sum())
    taken = rng.binomial(colors, sample / total) if total else np.zeros_like(colors)
    lack = sample - int(taken.sum())
    if lack:
        ends = np.cumsum(colors - taken if lack > 0 else taken)
        drawn = rng.choice(int(ends[-1]), abs(lack), replace=False, shuffle=False)
        moved = np.bincount(np.searchsorted(ends, drawn, side="right"), minlength=len(colors))
        taken += moved if lack > 0 else -moved
    return taken


def row_of_matrix(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """The row of partition ``part``: at each node the left half's share is drawn."""
    sums = np.concatenate(([0], np.cumsum(counts)))
    low, high, colors, node = 0, len(counts), sizes.copy(), 1
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng((seed, node)), colors, int(sums[mid] - sums[low]))
        if part < mid:
            high, colors, node = mid, left, 2 * node
        else:
            low, colors, node = mid, colors - left, 2 * node + 1
    return colors


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = 42, cell: int = CELL) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to ``rows``; columns of
    these names are replaced, all others may have any name and type. Every row
    is placed, repeated and null ones too; an empty table gives none; ties of the
    random order go by the row's place in its partition. Equal texts are not
    kept together: a group of copies may be larger than a shard.

    Partitions are counted and dealt out from a reliable checkpoint, so both
    passes, and any task that runs again, see the same rows in each. What is
    broadcast has 8 bytes for each partition, MOST_PARTITIONS at most, and for
    each cell (a megabyte for eight billion rows)."""
    spark = rows.sparkSession
    scratch(spark)  # so that there is a checkpoint folder
    rows = rows.drop("shard", "slot")
    if rows.rdd.getNumPartitions() > MOST_PARTITIONS:
        rows = rows.coalesce(MOST_PARTITIONS)
    columns = rows.columns
    names = [f"c{k}" for k in range(len(columns))]
    rows = rows.toDF(*names).checkpoint()
    parts = rows.rdd.getNumPartitions()
    counts = np.zeros(max(1, parts), np.int64)
    for p, n in rows.groupBy(F.spark_partition_id().alias("p")).count().collect():  # one row a partition
        counts[p] = n
    total = int(counts.sum())
    shared = spark.sparkContext.broadcast((counts, np.array([n for *_, n in cells(total, shards, cell)], np.int64)))
    own = ["cell", "shard", "first", "order", "row"]
    schema = StructType([*rows.schema.fields, *(StructField(n, IntegerType() if k < 2 else LongType()) for k, n in enumerate(own))])

    def deal(batches):
        counts, sizes = shared.value
        part, rng, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if rng is None:
                layout = np.array(cells(total, shards, cell), np.int64)
                rng = np.random.default_rng((seed, part, 1))
                to = np.repeat(np.arange(len(sizes)), row_of_matrix(counts, sizes, part, seed))
                rng.shuffle(to)
            n = batch.num_rows
            own_cells, at = to[at : at + n], at + n
            extra = (own_cells.astype(np.int32), layout[own_cells, 0].astype(np.int32), layout[own_cells, 1], rng.integers(0, 1 << 62, n), (part << 40) + np.arange(at - n, at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], names=[*names, *own])

    inside = F.row_number().over(Window.partitionBy("cell").orderBy("order", "row")) - 1
    dealt = rows.mapInArrow(deal, schema).withColumn("slot", (F.col("first") + inside).cast("long"))
    return dealt.select(*names, "shard", "slot").toDF(*columns, "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums come from whole texts; only these, not the texts, are exchanged."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    got = shuffled(rows)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
