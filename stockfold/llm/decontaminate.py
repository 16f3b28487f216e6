"""Benchmark decontamination by a prefix-filtered set join.

Every window (ten consecutive item words; all words of a shorter item) is a set
of three-word shingles. The shingles are ordered by their rarity in the whole
corpus. As the whole window has to occur, its prefix is its one rarest shingle:
documents are joined with the windows on that shingle alone, candidates that
can't fit by position or length are dropped, the rest is verified word by word.

Benchmark windows are taken in blocks of about BLOCK_WORDS words, a fixed size,
so what is broadcast is bounded: rows that repeat count once, and long items are
cut into pieces that share their windows out. A larger benchmark takes more
blocks, each of which sees all documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField

from .common import ALNUM_WORDS, appended, octets, small_batches, table, written

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 200_000
#: Blocks that run in one stage before their sums are written.
CHAIN = 4
#: Windows of one piece of an item, bytes of a text and candidates that are taken at a time.
ITEM_PIECE, PIECE, CANDIDATES = 10_000, 1 << 20, 1 << 18


def words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_WORDS).split() if text else []


class Block:
    """The windows of some items, and where their shingles stand."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.ids = sorted({i for i, _ in items}, key=lambda i: (i is not None, i or ""))
        at = {x: k for k, x in enumerate(self.ids)}
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.base = len(self.vocab) + 1
        owners: dict[tuple[int, ...], set[int]] = {}
        for i, ws in items:
            own = [self.vocab[w] for w in ws]
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                owners.setdefault(tuple(own[k : k + size]), set()).add(at[i])
        self.windows = list(owners)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.zeros((len(self.windows), window), np.int64)
        for k, w in enumerate(self.windows):
            self.matrix[k, : len(w)] = w
        self.codes = {
            s: np.unique([c for w in self.windows if min(SHINGLE, len(w)) == s for c in self.shingles(np.array(w), s)]).astype(np.int64)
            for s in range(1, SHINGLE + 1)
        }

    def shingles(self, ids: np.ndarray, size: int) -> np.ndarray:
        m = len(ids) - size + 1
        out = np.zeros(max(m, 0), np.int64)
        for k in range(size):
            out = out * self.base + ids[k : k + max(m, 0)]
        return out

    def encode(self, text: bytes | None) -> np.ndarray:
        parts, at, text = [], 0, text or b""
        while at < len(text):
            stop = at + PIECE
            while stop < len(text) and ALNUM_WORDS[text[stop]] != 32:
                stop += 1
            own = words(text[at:stop])
            parts.append(np.fromiter((self.vocab.get(w, 0) for w in own), np.int64, len(own)))
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def found(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that any window has, and their numbers among ``codes[size]``."""
        known, codes = self.codes[size], self.shingles(ids, size)
        full = ids != 0
        whole = full[: len(codes)].copy()
        for k in range(1, size):
            whole &= full[k : k + len(codes)]
        at = whole.nonzero()[0]
        if not len(known) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
        same = known[k] == codes[at]
        return at[same], k[same]

    def order(self, seen: dict[int, np.ndarray]) -> None:
        """Chooses each window's rarest shingle; ``seen``: documents that have the shingle, by number."""
        self.prefix = {}
        for size, known in self.codes.items():
            lists: list[list[tuple[int, int]]] = [[] for _ in known]
            for w, ids in enumerate(self.windows):
                if min(SHINGLE, len(ids)) == size:
                    own = np.searchsorted(known, self.shingles(np.array(ids), size))
                    p = min(range(len(own)), key=lambda i: (seen[size][own[i]], own[i], i))
                    lists[own[p]].append((w, p))
            start = np.cumsum([0, *map(len, lists)])
            flat = np.array([x for y in lists for x in y], np.int64).reshape(-1, 2)
            self.prefix[size] = (start, flat[:, 0], flat[:, 1])

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the document and numbers of the windows that occur there."""
        starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.codes:
            at, code = self.found(ids, size)
            begin, window, offset = self.prefix[size]
            n = begin[code + 1] - begin[code]
            upto = np.cumsum(n)
            cut = [0, *np.searchsorted(upto, np.arange(CANDIDATES, upto[-1], CANDIDATES)).tolist(), len(n)] if len(n) else []
            for a, b in zip(cut, cut[1:]):
                # one row for each pair of a shingle's place and a window with that prefix
                m = n[a:b]
                row = np.repeat(begin[code[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                w = window[row]
                s = np.repeat(at[a:b], m) - offset[row]
                fits = (s >= 0) & (s + self.lengths[w] <= len(ids))
                w, s = w[fits], s[fits]
                for k in range(self.matrix.shape[1]):
                    same = (k >= self.lengths[w]) | (ids[np.minimum(s + k, len(ids) - 1)] == self.matrix[w, k])
                    w, s = w[same], s[same]
                starts.append(s)
                which.append(w)
        return np.concatenate(starts), np.concatenate(which)


def rarity(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """For each shingle of the block: documents, of all, that have it."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        own = shared.value
        sums = {s: np.zeros(len(c), np.int64) for s, c in own.codes.items()}
        for batch in batches:
            for text in octets(batch.column(0)):
                ids = own.encode(text)
                for s in sums:
                    sums[s][np.unique(own.found(ids, s)[1])] += 1
        for s, n in sums.items():
            at = n.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at), pa.array(n[at])], names=["size", "code", "n"])

    got = docs.select("text").mapInArrow(count, "size long, code long, n long").groupBy("size", "code").agg(F.sum("n").alias("n"))
    out = {s: np.zeros(len(c), np.int64) for s, c in block.codes.items()}
    for size, code, n in got.collect():  # a row for each shingle of the block at most
        out[size][code] = n
    return out


def blocks(items: DataFrame, window: int, block_words: int, unnamed: bool):
    """Items in blocks, each small enough to be broadcast. Rows that share an
    item_id are one item with several texts, equal rows are one; a null text has
    no windows, a null item_id only if ``unnamed``. The pieces of a long item
    overlap by a window less one word, so each window is in one piece."""
    kept = items.where("text is not null" if unnamed else "item_id is not null and text is not null")
    rows = kept.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    step = max(1, min(ITEM_PIECE, block_words))

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), octets(batch.column(1))):
                own = words(text)
                for k in range(0, max(1, len(own) - window + 1), step):
                    piece = own[k : k + step + window - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([b" ".join(piece)], pa.binary()), pa.array([len(piece)], pa.int64())], names=["item_id", "piece", "n"])

    pieces = written(rows.mapInArrow(cut, "item_id string, piece binary, n long").where("n > 0"), "windows")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    for k in range(count):
        part = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(count)) == k) if count > 1 else pieces
        yield Block([(r.item_id, bytes(r.piece).split()) for r in part.toLocalIterator()], window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> DataFrame:
    """Adds n_words, n_hit, spans (packed pairs of hit word ranges), item_ids
    (sorted as strings) and contaminated; columns of these names are replaced.
    Null and empty texts have no words; texts of any length are read whole, piece
    by piece; without items nothing is hit; repeated rows are judged each by
    itself; of shingles that are equally rare the one that comes first stands for
    its window. With ``unnamed`` the windows of items without an id hit too, but
    give no item_ids."""
    spark = docs.sparkSession
    small_batches(spark)
    fields = [
        StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("spans", BinaryType()),
        StructField("item_ids", ArrayType(StringType())), StructField("contaminated", BooleanType()),
    ]
    out = docs
    for number, block in enumerate(blocks(items, window, block_words, unnamed)):
        block.order(rarity(docs, block))
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared, first=number == 0):
            own = shared.value

            def each(batch: pa.RecordBatch) -> list:
                columns = [[], [], [], [], []]
                before = [(None, None)] * batch.num_rows if first else list(zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist()))
                for text, (spans, ids) in zip(octets(batch.column("text")), before):
                    doc = own.encode(text)
                    start, which = own.occurrences(doc)
                    edge = np.zeros(len(doc) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + own.lengths[which], -1)
                    if spans:
                        pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 1], -1)
                    hit = np.cumsum(edge)[:-1] > 0
                    turn = np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))).nonzero()[0]
                    items = {own.ids[i] for w in set(which.tolist()) for i in own.owners[w]} | set(ids or ())
                    items.discard(None)
                    for column, x in zip(columns, (len(doc), int(hit.sum()), turn.astype("<i8").tobytes(), sorted(items), bool(hit.any()))):
                        column.append(x)
                return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.bool_()))]

            return each

        out = appended(out, fields, make)
        if number % CHAIN == CHAIN - 1:
            out = written(out, "contamination")
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = contamination(docs, table(spark, sf_dir, "benchmark"), unnamed=True)
    sha = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same result by trying every window at every place; for tests."""
    out = []
    for doc_id, text in docs:
        d = words((text or "").encode())
        hit, own = set(), set()
        for item, t in items:
            i = words((t or "").encode())
            size = min(window, len(i))
            for k in range(len(i) - size + 1 if i else 0):
                for p in range(len(d) - size + 1):
                    if d[p : p + size] == i[k : k + size]:
                        hit.update(range(p, p + size))
                        own.add(str(item))
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((doc_id, len(d), len(hit), len(own), sha, bool(hit)))
    return out
