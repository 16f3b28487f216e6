"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in
turns, ending with the assistant. Dynamic programming over that automaton
chooses, for each turn, to keep or change its role, to append it to the turn
before it, or to insert an empty turn first, at the least total cost.

The programme's step is a min-plus matrix over the four states, so a long
conversation is cut into blocks of BLOCK turn numbers (a crowded one finer):
blocks are reduced to their matrices, the chain of matrices gives each block its
first and last state, and blocks are then repaired apart from each other."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import small_batches, table, written

BLOCK = 1024
#: Stretches of a conversation that are hot have over 1/HOT_KEYS of all turns, and MOST_TURNS at least.
HOT_KEYS, MOST_TURNS = 1024, 1 << 14
ROLES = ("system", "user", "assistant")
START = 3  # the state before any turn; other states are the last role's number
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3
#: What ending in a state costs, and the empty turns that it takes.
CLOSE = {START: (0, ()), 0: (2 * INSERT, (1, 2)), 1: (INSERT, (2,)), 2: (0, ())}


def moves(role: int | None) -> list[list[tuple[float, int, bool] | None]]:
    """[from][to]: (cost, inserted role or -1, whether merged) of the best way to take a turn of ``role``."""
    out = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for label in range(3):
            cost = 0 if label == role else RELABEL_UNKNOWN if role is None else RELABEL
            ways = [(cost, -1, False)] if label in NEXT[s] else []
            ways += [(cost + MERGE, -1, True)] if label == s else []
            ways += [(cost + INSERT, x, False) for x in NEXT[s] if label in NEXT[x]]
            if ways:
                out[s][label] = min(ways)
    return out


MOVES = {r: moves(r) for r in (None, 0, 1, 2)}
NUMBER = {r: k for k, r in enumerate(ROLES)}


def matrix(roles: list[str | None]) -> list[float]:
    """Least costs from each state to each over these turns, row by row."""
    out = []
    for s in range(4):
        cost = [math.inf] * 4
        cost[s] = 0.0
        for r in roles:
            step, new = MOVES[NUMBER.get(r)], [math.inf] * 4
            for a in range(4):
                for b in range(3):
                    if step[a][b] and cost[a] + step[a][b][0] < new[b]:
                        new[b] = cost[a] + step[a][b][0]
            cost = new
        out += cost
    return out


def repair(roles: list[str | None], first: int, last: int | None) -> tuple[float, list[tuple[int, int, bool]]]:
    """Least cost and, for each turn, (label, inserted role or -1, merged), from
    state ``first`` to ``last``, or to any end if that is None."""
    cost, back = [math.inf] * 4, []
    cost[first] = 0.0
    for r in roles:
        step, new, came = MOVES[NUMBER.get(r)], [math.inf] * 4, [-1] * 4
        for a in range(4):
            for b in range(3):
                if step[a][b] and cost[a] + step[a][b][0] < new[b]:
                    new[b], came[b] = cost[a] + step[a][b][0], a
        cost = new
        back.append(came)
    end = last if last is not None else min(range(4), key=lambda s: (cost[s] + CLOSE[s][0], s))
    total, out, s = cost[end] + (CLOSE[end][0] if last is None else 0), [], end
    for r, came in zip(reversed(roles), reversed(back)):
        _, inserted, merged = MOVES[NUMBER.get(r)][came[s]][s]
        out.append((s, inserted, merged))
        s = came[s]
    return total, out[::-1]


def opened(role: int, text: str) -> str:
    return f"<|{ROLES[role]}|>\n{text}"


def blocked(turns: DataFrame) -> DataFrame:
    """Turns with their block, an array that orders the blocks of a conversation:
    (stretch of BLOCK numbers, -1, 0). Numbered rows that are equal in all columns
    are one turn, met ``n`` times; equal rows without a number are turns each,
    told apart by ``copy``.

    A stretch in which a conversation has over 1/HOT_KEYS of all rows (say, that
    of all rows without conv_id) is cut finer, by its numbers and then by a hash
    of the turn: (stretch, number, bucket). Its turns of one number are in the
    order of that hash. There are HOT_KEYS such stretches at most, so what is
    broadcast has no more than HOT_KEYS * BLOCK rows."""
    last = F.lit(2**62)
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    copies = F.when(F.col("turn").isNull(), F.col("n")).otherwise(1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    rows = rows.withColumn("n", F.when(F.col("turn").isNull(), 1).otherwise(F.col("n"))).withColumn("number", F.coalesce(F.col("turn").cast("long"), last))
    rows = rows.withColumn("stretch", F.floor(F.col("number") / BLOCK).cast("long"))
    rows = written(rows, "turns")  # it is read several times
    share = max(rows.count() // HOT_KEYS + 1, MOST_TURNS)
    by_number = rows.groupBy("conv_id", "stretch", "number").agg(F.count("*").alias("m"))
    hot = by_number.groupBy("conv_id", "stretch").agg(F.sum("m").alias("all"), F.collect_list(F.struct("number", "m")).alias("of")).where(F.col("all") > share)
    hot = hot.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.inline("of")).withColumn("buckets", F.ceil(F.col("m") / BLOCK)).withColumnRenamed("number", "x")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")) & (F.col("number") == F.col("x"))
    rows = rows.join(F.broadcast(hot), same, "left")
    bucket = F.pmod(F.xxhash64("role", "text", "copy"), F.col("buckets"))
    blk = F.when(F.col("buckets").isNull(), F.array("stretch", F.lit(-1).cast("long"), F.lit(0).cast("long"))).otherwise(F.array("stretch", "number", bucket))
    return rows.select("conv_id", "turn", "role", "text", "copy", "n", blk.alias("blk"))


#: The turns of a block in order.
OWN = ("turn", "role", "text", "copy", "n")


def ordered(columns: tuple[str, ...]):
    return F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("null"), *columns)))


def chains(rows: DataFrame) -> DataFrame | None:
    """(conv_id, blk, first, last) of the blocks of conversations that have
    several; None if there are no such conversations."""
    long_ = rows.groupBy("conv_id").agg(F.min("blk").alias("low"), F.max("blk").alias("high")).where("low <> high").select(F.col("conv_id").alias("c"))
    if long_.isEmpty():
        return None
    part = rows.join(long_, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    # ties of number and role go by the text, which does not matter here: only numbers and roles are gathered
    sums = part.groupBy("conv_id", "blk").agg(F.transform(ordered(("turn", "role")), lambda t: t["role"]).alias("roles"))

    def reduced(batches):
        for batch in batches:
            m = [matrix(r) for r in batch.column("roles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("blk"), pa.array(m, pa.list_(pa.float64()))], names=["conv_id", "blk", "m"])

    def chained(t: pa.Table) -> pa.Table:
        blk = t["blk"].to_pylist()
        t = t.take(sorted(range(len(blk)), key=blk.__getitem__))
        steps = [np.array(m).reshape(4, 4) for m in t["m"].to_pylist()]
        cost, came = np.full(4, np.inf), []
        cost[START] = 0
        for m in steps:
            way = cost[:, None] + m
            came.append(way.argmin(0))
            cost = way.min(0)
        s = min(range(4), key=lambda x: (cost[x] + CLOSE[x][0], x))
        lasts, firsts = [], []
        for c in reversed(came):
            lasts.append(s)
            s = int(c[s])
            firsts.append(s)
        lasts = lasts[::-1]
        lasts[-1] = None
        return pa.table({"conv_id": t["conv_id"], "blk": t["blk"], "first": pa.array(firsts[::-1], pa.int32()), "last": pa.array(lasts, pa.int32())})

    kind = rows.schema["conv_id"].dataType.simpleString()
    made = sums.mapInArrow(reduced, f"conv_id {kind}, blk array<long>, m array<double>")
    return made.groupBy("conv_id").applyInArrow(chained, f"conv_id {kind}, blk array<long>, first int, last int")


def formatted(turns: DataFrame) -> DataFrame:
    """One row for each turn of (conv_id, turn, role, text): seq (its place in
    the block), n (rows that are this turn), action (keep, relabel, merge,
    relabel+merge), out_role, inserted (the role of an empty turn put before it,
    else null), ended (the empty turns put after the last one) and piece. A
    conversation's pieces by (blk, seq) make up its rendered text. An empty table
    gives none; texts of any length are rendered whole.

    Turns are ordered by (turn, role, text), null turns last. Numbered rows equal
    in all of these are one turn, equal rows without a number are turns each.
    Roles other than system, user and assistant, and null ones, have to be
    relabelled; a null text is an empty one; a null conv_id is a conversation
    like any other."""
    small_batches(turns.sparkSession)
    rows = blocked(turns)
    chain = chains(rows)
    blocks = rows.groupBy("conv_id", "blk").agg(ordered(OWN).alias("turns"))
    if chain is None:
        blocks = blocks.withColumns({"first": F.lit(START), "last": F.lit(None).cast("int"), "tail": F.lit(True)})
    else:
        c = chain.select(F.col("conv_id").alias("c"), F.col("blk").alias("b"), "first", "last")
        blocks = blocks.join(c, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("blk") == F.col("b")), "left").drop("c", "b")
        blocks = blocks.withColumn("tail", F.col("last").isNull()).withColumn("first", F.coalesce("first", F.lit(START)))
    kinds = {n: turns.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    schema = f"conv_id {kinds['conv_id']}, blk array<long>, seq int, n long, turn {kinds['turn']}, role string, action string, out_role string, inserted string, ended string, piece string"
    names = [x.split()[0] for x in schema.split(", ")]

    def write(batches):
        for batch in batches:
            out = []
            for conv, blk, own, first, last, tail in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "blk", "turns", "first", "last", "tail"))):
                _, plan = repair([t["role"] for t in own], first, last)
                open_ = first != START
                for k, (t, (label, inserted, merged)) in enumerate(zip(own, plan)):
                    changed = t["role"] != ROLES[label]
                    piece = ""
                    if merged:
                        piece = "\n" + t["text"]
                    else:
                        piece = "<|end|>\n" if open_ else ""
                        if inserted >= 0:
                            piece += opened(inserted, "") + "<|end|>\n"
                        piece += opened(label, t["text"])
                    open_, ended = True, ()
                    if tail and k == len(own) - 1:
                        ended = CLOSE[label][1]
                        piece += "<|end|>\n" + "".join(opened(r, "") + "<|end|>\n" for r in ended)
                    action = "+".join(["relabel"] * changed + ["merge"] * merged) or "keep"
                    out.append((conv, blk, k, t["n"], t["turn"], t["role"], action, ROLES[label], ROLES[inserted] if inserted >= 0 else None, ",".join(ROLES[r] for r in ended) or None, piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, types.field(n).type) for n, c in zip(names, zip(*out))], names=names)

    types = to_arrow_schema(StructType.fromDDL(schema))
    return blocks.mapInArrow(write, schema)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = formatted(table(spark, sf_dir, "conversations"))
    sha = F.sha2(F.col("piece").cast("binary"), 256).alias("piece_sha256")
    return got.select("conv_id", "turn", "role", "n", "action", "out_role", "inserted", "ended", sha)
