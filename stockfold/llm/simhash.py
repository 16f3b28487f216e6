"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of five segments. If two differ in at most
four bits, some chain of consecutive segments keeps within its proportional
budget at every length: no differing bit in one segment, one in two, two in
three, three in four (the strong pigeonring principle, k * 4 / 5 rounded down).
Candidates meet on keys that any such chain implies; a candidate must keep to
the budgets along the chain before the full Hamming distance is taken.

Links are not listed by pairs: from each bucket of candidates only a spanning
forest of its verified links leaves, and components are found over distinct
fingerprints by alternating stars."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import ASCII_LOWER, appended, joined_to_classes, octets, small_batches, table, written

BITS, DISTANCE, SEGMENTS = 64, 4, 5
SHINGLE = 4
SEED = 42
EDGES = [round(k * BITS / SEGMENTS) for k in range(SEGMENTS + 1)]
#: Fingerprints of one bucket that a task compares; larger buckets are split in pairs of blocks.
BLOCK = 1 << 14
PIECE = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Bit i is set if over half of the shingles' hashes have it; no words: 0."""
    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        h = np.array([digest(norm[a:b], SEED) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds fp, the fingerprint as a signed long; texts are dropped."""

    def make():
        return lambda batch: [pa.array([fingerprint(t) for t in octets(batch.column("text"))], pa.int64())]

    return appended(docs, [StructField("fp", LongType())], make, drop=("text",))


def mask(bits) -> int:
    return sum(1 << b for b in bits)


def ring(start: int, segments: int) -> list[int]:
    """The bits of some consecutive segments from ``start`` on."""
    return [b for k in range(segments) for b in range(EDGES[(start + k) % SEGMENTS], EDGES[(start + k) % SEGMENTS + 1])]


def keys(level: int) -> list[tuple[int, int]]:
    """(chain start, mask of bits that are equal): every pair within the
    distance agrees on one of these masks at least. The first segment is equal.
    The next ``level`` segments together have ``level`` differing bits at most;
    cut into c parts, c - level of these are equal."""
    out = []
    for i in range(SEGMENTS):
        first = ring(i, 1)
        rest = ring(i, 1 + level)[len(first) :]
        c = 0 if not level else 2 * level
        parts = [rest[round(k * len(rest) / c) : round((k + 1) * len(rest) / c)] for k in range(c)]
        for chosen in combinations(parts, c - level):
            out.append((i, mask(first) | mask(b for p in chosen for b in p)))
    return out


def level_for(n: int) -> int:
    """Longer keys for more fingerprints: about n / 2^13, 2^19, 2^26, 2^32 meet by
    chance. At every level all links are found; only the work differs."""
    return 0 if n < 1 << 13 else 1 if n < 1 << 20 else 2 if n < 1 << 29 else 3


CHAINS = [
    [(np.uint64(mask(ring(i, k))), k * DISTANCE // SEGMENTS) for k in range(1, SEGMENTS)] for i in range(SEGMENTS)
]


def near(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Numbers of ``others`` that differ in DISTANCE bits at most and keep the
    budgets of the chain from ``start``."""
    at = np.arange(len(others))
    x = others ^ one
    for bits, budget in CHAINS[start]:
        fit = np.bitwise_count(x & bits) <= budget
        at, x = at[fit], x[fit]
        if not len(at):
            return at
    return at[np.bitwise_count(x) <= DISTANCE]


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that the chain from ``start`` shows among
    distinct fingerprints. What one reaches leaves the open set, so a dense
    group takes few passes."""
    out, open_ = [], fps
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            one = queue.pop()
            got = near(one, open_, start)
            if len(got):
                out += [(one, x) for x in open_[got]]
                queue += list(open_[got])
                open_ = np.delete(open_, got)
    return out


def links(distinct: DataFrame, block: int = BLOCK, level: int | None = None) -> DataFrame:
    """(a, b) from distinct fingerprints (fp): links whose components are those
    of all links. Buckets of more than ``block`` are split: each pair of blocks
    is one unit of work, so that no task gets an unbounded bucket."""
    level = level_for(distinct.count()) if level is None else level
    made = keys(level)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, (_, m) in enumerate(made))))
    rows = distinct.select("fp", each.alias("x")).select("fp", "x.k", "x.v")
    large = rows.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("k", "v", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    if large.isEmpty():
        units = rows.withColumn("cell", F.lit(0))
    else:
        # block j of a bucket goes to the cells (j, 0), (j, 1), ... of the triangle
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))
        units = rows.join(large, ["k", "v"], "left").select("fp", "k", "v", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"))
    small_batches(distinct.sparkSession, 10_000)
    starts = [i for i, _ in made]

    def join(batches):
        def close(key, parts):
            fps = np.unique(np.concatenate(parts)).view(np.uint64)
            return forest(fps, starts[key[0]]) if len(fps) > 1 else []

        held, parts, got = None, [], []
        for batch in batches:
            k, v, cell, fp = (batch.column(n).to_numpy() for n in ("k", "v", "cell", "fp"))
            turn = np.concatenate(([0], ((np.diff(k) != 0) | (np.diff(v) != 0) | (np.diff(cell) != 0)).nonzero()[0] + 1, [len(k)]))
            for a, b in zip(turn[:-1], turn[1:]):
                key = (int(k[a]), int(v[a]), int(cell[a])) if b > a else held
                if key != held:
                    if held is not None and sum(map(len, parts)) > 1:
                        got += close(held, parts)
                    held, parts = key, []
                parts.append(fp[a:b].copy())
            if len(got) > 10_000:
                yield pairs(got)
                got = []
        if held is not None:
            got += close(held, parts)
        if got:
            yield pairs(got)

    def pairs(got):
        both = np.array(got, np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "k", "v", "cell").sortWithinPartitions("k", "v", "cell")
    return units.mapInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of an edge: root is the smallest vertex of its
    component, by alternating large and small stars. Each round is written to
    the shared folder. A star's hub may have a third of all edges: its edges are
    dealt over several tasks where they meet the least neighbour."""
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return spark.createDataFrame([], "v long, root long")
    low = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    of = lambda e: written(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
    meet = lambda e, stars: joined_to_classes(e, stars, "a", "n", F.xxhash64("b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each larger neighbour is linked to the least of the neighbourhood
        large = meet(both, of(both)).where("b > a").select(F.least("m", "a").alias("a"), "b").where("a <> b").distinct()
        # small star: each smaller neighbour and the vertex itself
        down = written(large.select(F.col("b").alias("a"), F.col("a").alias("b")), "down")
        stars = of(down)
        small = meet(down, stars).select("m", F.col("b").alias("x")).unionByName(stars.select("m", F.col("a").alias("x")))
        edges = written(low(small.select(F.col("m").alias("a"), F.col("x").alias("b"))).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("v"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("v"), F.col("a").alias("root"))).distinct()


def grouped(docs: DataFrame, block: int = BLOCK, level: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and key, a text's digest) without the text: fp,
    component_id (the smallest non-null doc_id of the component, null if it has
    none) and first, whether the row is the one that stands for its component:
    that of the smallest doc_id (any before null), then of the smallest key."""
    fps = written(fingerprints(docs), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    one = written(fps.groupBy("fp").agg(F.min(own).alias("best"), F.count("*").alias("rows")), "distinct")
    roots = written(components(links(one.select("fp"), block, level)), "roots")
    merged = one.join(roots, one.fp == roots.v).groupBy("root").agg(F.min("best").alias("of_all"), F.count("*").alias("vertices"))
    of = joined_to_classes(roots, written(merged, "merged"), "root", "vertices", F.xxhash64("v"))
    named = one.join(of.select(F.col("v").alias("fp"), "of_all"), "fp", "left")
    named = written(named.select("fp", "rows", F.coalesce("of_all", "best").alias("best")), "named")
    joined = joined_to_classes(fps, named, "fp", "rows", F.monotonically_increasing_id())
    return joined.select("doc_id", "key", "fp", F.col("best.doc_id").alias("component_id"), (own == F.col("best")).alias("first"))


def groups(docs: DataFrame, block: int = BLOCK, level: int | None = None) -> DataFrame:
    """doc_id, fp and component_id for every row of (doc_id, text). Null and
    empty texts have the fingerprint 0 and are linked like any other; an empty
    table gives none; texts of any length count whole; repeated rows are rows of
    one component. component_id is as in ``grouped``."""
    rows = docs.select("doc_id", "text", F.lit("").alias("key"))
    return grouped(rows, block, level).select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
