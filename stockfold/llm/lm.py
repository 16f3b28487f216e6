"""Interpolated modified Kneser-Ney language model (bigrams) over a corpus that
no worker could hold the model of.

Fitting: training texts are read in blocks of BLOCK_BYTES. A block's distinct
bigrams and words with their counts go as packed arrays to the parts that own
them by hash. Each part adds up what all blocks sent and stores its share of the
model: sorted arrays of hashes with their counts, a row of a Parquet table in the
shared folder. ``Model`` names that folder; it can be loaded again at any time.

Scoring: texts are read in blocks. A block asks each part for what it has of its
bigrams and words; the worker that has a part puts its arrays into a file, maps
that into memory and looks the questions up. The answers meet the block's texts,
which are read a second time for that, where they are scored; were the blocks not
the same, scoring would stop with an error. Nothing of the model is broadcast but
a dozen totals.

Words are known by 64-bit hashes, a bigram in its part by 48 bits of its own: at
700,000 bigrams a part (parts grow with the corpus) one in 400 million unseen
bigrams is taken for another. Counts of words and the base score do not use these.

A bigram's part depends on its first word's hash and some bits of the second's,
so a frequent word's followers are spread, and blocks pre-aggregate. What is
exchanged grows with the input in bytes; the number of packets is that of blocks
times parts, about ten million at 30 GB. For terabytes raise BLOCK_BYTES."""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, octets, release, remainder, scratch, small_batches, table

BLOCK_BYTES = 16 << 20
PIECE = 1 << 20
END, BEGIN = 0, 1
ROWS = "kind string, part int, block long, payload binary"


class Words(dict):
    """Local numbers of a block's words, in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def hash_of(word: bytes) -> int:
    return max(2, xxhash.xxh3_64_intdigest(word))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the upper half of the hash, so in the order of the hashes."""
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, as wide as the largest needs."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        wide = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out.append(len(a).to_bytes(8, "little") + bytes([wide]) + a.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    while at < len(raw):
        n, wide = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        planes = np.frombuffer(raw, np.uint8, n * wide, at + 9).reshape(wide, n)
        a = np.zeros((n, 8), np.uint8)
        a[:, :wide] = planes.T
        out.append(a.reshape(-1).view("<u8"))
        at += 9 + n * wide
    return out


def local_numbers(text: bytes, words: Words) -> np.ndarray:
    """Words of a text, piece by piece, then the end."""
    parts, at = [], 0
    while at < len(text):
        stop = at + PIECE
        while stop < len(text) and text[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        own = text[at:stop].translate(ASCII_LOWER).split()
        parts.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
        at = stop
    parts.append(np.array([END], np.int32))
    return np.concatenate(parts)


class Block:
    """Some texts by the ranks of their words' hashes among the block's sorted hashes."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray):
        self.hashes, self.tokens, self.sizes, self.held = hashes, tokens, sizes, held
        self.first = np.cumsum(sizes) - sizes

    def bigrams(self) -> np.ndarray:
        """Of each token the rank of the word before it, times the number of
        words, plus its own; sorted, they are in the order of the hashes."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.first] = BEGIN  # the hashes 0 and 1 come first
        return before * len(self.hashes) + self.tokens

    def words(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(bigrams, len(self.hashes))


def blocks(batches, block_bytes: int):
    """Gives (number, doc ids, held, Block) from batches of (doc_id, text, held)."""
    task, number = TaskContext.get().partitionId() << 32, 0

    def close():
        raw = np.fromiter(chain((END, BEGIN), map(hash_of, islice(words, 2, None))), np.uint64, len(words))
        hashes, rank = np.unique(raw, return_inverse=True)
        return Block(hashes, rank.astype(np.int32)[np.concatenate(tokens)], np.array([len(t) for t in tokens], np.int64), np.array(held, bool))

    words, tokens, held, ids, size = Words(), [], [], [], 0
    words[b" end"], words[b" begin"] = END, BEGIN
    for batch in batches:
        for doc_id, text, own in zip(batch.column(0).to_pylist(), octets(batch.column(1)), batch.column(2).to_pylist()):
            text = text or b""
            tokens.append(local_numbers(text, words))
            held.append(own)
            ids.append(doc_id)
            size += len(text) + 64
            if size >= block_bytes:
                yield task | number, ids, close()
                number += 1
                words, tokens, held, ids, size = Words(), [], [], [], 0
                words[b" end"], words[b" begin"] = END, BEGIN
    if ids:
        yield task | number, ids, close()


def owners(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """The parts of bigrams, by the hashes of their words."""
    spread = np.uint64(max(8, parts // 8))
    return part_of(mix(first, second % spread), parts).astype(np.uint16)


def cuts(sorted_parts: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that occur."""
    at = np.searchsorted(sorted_parts, np.arange(parts + 1))
    return [(p, a, b) for p, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]


def distinct(a: np.ndarray) -> np.ndarray:
    """As np.unique, by sorting; that hashes, which is slower here."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def in_parts(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order by part, and by key in each part."""
    order = np.argsort(keys)
    return order[np.argsort(owner[order], kind="stable")]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    columns = zip(*rows) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "part", "block", "payload"])


def deltas(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_[:1] * 0)


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal neighbours."""
    start = np.concatenate(([0], np.diff(a).nonzero()[0] + 1)) if len(a) else np.zeros(0, np.int64)
    return a[start], np.diff(np.append(start, len(a)))


def counted(batches, block_bytes: int, parts: int):
    """What blocks send to the parts: bigrams by first word with the hashes of
    the second, and words, each with their counts."""
    for number, _, block in blocks(batches, block_bytes):
        bigrams, n = np.unique(block.bigrams(), return_counts=True)
        one, two = block.words(bigrams)
        first, second = block.hashes[one], block.hashes[two]
        owner = owners(first, second, parts)
        order, rows = np.argsort(owner, kind="stable"), []
        first, second, n = first[order], second[order], n[order]
        for p, a, b in cuts(owner[order], parts):
            value, length = runs(first[a:b])
            rows.append(("bigrams", p, number, pack(deltas(value), length, second[a:b], n[a:b])))
        sums = np.bincount(block.tokens, minlength=len(block.hashes))
        for p, a, b in cuts(part_of(block.hashes, parts), parts):
            rows.append(("words", p, number, pack(deltas(block.hashes[a:b]), sums[a:b])))
        yield batch(rows)


def asked(batches, block_bytes: int, parts: int):
    """What blocks ask the parts: sorted hashes."""
    for number, _, block in blocks(batches, block_bytes):
        keys, owner = questions(block, distinct(block.bigrams()), parts)
        order, rows = in_parts(keys, owner), []
        for p, a, b in cuts(owner[order], parts):
            rows.append(("ask bigrams", p, number, pack(deltas(keys[order[a:b]]))))
        for p, a, b in cuts(part_of(block.hashes, parts), parts):
            rows.append(("ask words", p, number, pack(deltas(block.hashes[a:b]))))
        yield batch(rows)


def packed_texts(batches, block_bytes: int):
    for number, ids, block in blocks(batches, block_bytes):
        doc_id = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
        yield batch([("texts", 0, number, pack(deltas(block.hashes), block.tokens, block.sizes, block.held, doc_id, np.array([i is not None for i in ids])))])


def key_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(second, first) >> np.uint64(16)


def questions(block: Block, bigrams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = block.words(bigrams)
    first, second = block.hashes[one], block.hashes[two]
    return key_of(first, second), owners(first, second, parts)


def of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64)


def add_bigrams(rows: pa.Table, parts: int) -> pa.Table:
    """A part's bigrams, sorted by their hashes, with their counts; the words'
    sums over them for the words' parts; and the totals."""
    got, out = [], []
    for kind, part, block, payload in zip(*(rows[c].to_pylist() for c in ("kind", "part", "block", "payload"))):
        if kind == "bigrams":
            got.append(unpack(payload))
        else:
            out.append((kind, part, block, payload))
    if got:
        first = np.concatenate([np.repeat(np.cumsum(v), n.astype(np.int64)) for v, n, _, _ in got])
        second, n = np.concatenate([x[2] for x in got]), np.concatenate([x[3] for x in got]).astype(np.int64)
        del got
        whole = mix(first, second)
        order = np.argsort(whole)
        start = np.concatenate(([0], np.diff(whole[order]).nonzero()[0] + 1))
        count = np.add.reduceat(n[order], start)
        first, second = first[order[start]], second[order[start]]
        keys = key_of(first, second)
        order = np.argsort(keys)
        out.append(("model", rows["part"][0].as_py(), None, pack(deltas(keys[order]), count[order])))
        words, role = np.unique(np.concatenate((first, second)), return_inverse=True)
        before, after = role[: len(first)], role[len(first) :]
        sums = [np.bincount(before, w, minlength=len(words)) for w in (count, count == 1, count == 2, count >= 3)]
        sums.append(np.bincount(after, minlength=len(words)))
        for p, a, b in cuts(part_of(words, parts), parts):
            out.append(("sums", p, None, pack(deltas(words[a:b]), *(s[a:b].astype(np.int64) for s in sums))))
        out.append(("totals", 0, None, of_counts(count).tobytes()))
    return pa.Table.from_batches([batch(out)])


def add_words(rows: pa.Table) -> pa.Table:
    """A part's words, sorted by their hashes: count, then as first word of
    bigrams the sum and the numbers of ones, twos and more, then the number of
    words before it; and the totals."""
    got = [(k, unpack(p)) for k, p in zip(rows["kind"].to_pylist(), rows["payload"].to_pylist())]
    hashes = [np.cumsum(x[0]) for _, x in got]
    words, same = np.unique(np.concatenate(hashes), return_inverse=True)
    stats, e = np.zeros((6, len(words)), np.int64), 0
    for (kind, x), h in zip(got, hashes):
        at = same[e : e + len(h)]
        e += len(h)
        if kind == "words":
            stats[0, at] += x[1].astype(np.int64)
        else:
            stats[1:, at] += np.array(x[1:]).astype(np.int64)
    c, before = stats[0], stats[5]
    totals = [c.sum(), (c > 0).sum(), before.sum(), (before > 0).sum(), (before >= 3).sum(), *of_counts(before)]
    return pa.Table.from_batches([batch([("words", rows["part"][0].as_py(), None, pack(deltas(words), *stats)), ("totals", 1, None, np.array(totals, np.int64).tobytes())])])


class Mapped:
    """Sorted hashes and what belongs to each, in a file that is mapped into memory."""

    def __init__(self, folder: str, name: str, payload: bytes | None, width: int):
        arrays = unpack(payload) if payload else [np.zeros(0, np.uint64)] * (1 + width)
        table = np.vstack((np.cumsum(arrays[0], dtype=np.uint64), *arrays[1:]))
        np.save(path := os.path.join(folder, f"{name}.npy"), table)
        del table, arrays
        self.table = np.load(path, mmap_mode="r")

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """A row for each value; 0 for hashes that are not there."""
        known = self.table[0]
        if not len(known):
            return np.zeros((len(self.table) - 1, len(hashes)), np.uint64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, self.table[1:, at], np.uint64(0))


def answers(rows: pa.Table) -> pa.Table:
    """A part's answers to all blocks, from its share of the model."""
    out = []
    columns = [rows[c].to_pylist() for c in ("kind", "part", "block", "payload")]
    with tempfile.TemporaryDirectory(prefix="lm-") as folder:
        shares = {k: p for k, _, _, p in zip(*columns) if k in ("model", "words")}
        model = {"ask bigrams": Mapped(folder, "bigrams", shares.get("model"), 1), "ask words": Mapped(folder, "words", shares.get("words"), 6)}
        for kind, part, block, payload in zip(*columns):
            if kind in model:
                out.append((kind[4:], part, block, pack(*model[kind].of(np.cumsum(unpack(payload)[0])))))
        del model
    return pa.Table.from_batches([batch(out)])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2, 3 and more; where a formula has no data, half a count."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


def score(rows: pa.Table, totals: tuple[np.ndarray, np.ndarray], parts: int) -> pa.Table:
    """The scores of a block's texts, from the answers of all parts."""
    of2, (n, v, pairs, kinds, more, *of1) = totals
    d2, d1 = discounts(*of2), discounts(*of1)
    by: dict[str, dict[int, bytes]] = {"texts": {}, "bigrams": {}, "words": {}}
    for kind, part, payload in zip(rows["kind"].to_pylist(), rows["part"].to_pylist(), rows["payload"].to_pylist()):
        by[kind][part] = payload
    if len(by["texts"]) != 1:
        raise RuntimeError("a block's texts are missing")
    steps, tokens, sizes, held, ids, known = unpack(*by["texts"].values())
    block = Block(np.cumsum(steps), tokens.astype(np.int64), sizes.astype(np.int64), held.astype(bool))
    each = block.bigrams()
    bigrams = distinct(each)
    got = {kind: np.concatenate([np.array(unpack(by[kind][p])) for p in sorted(by[kind])], axis=1).astype(np.float64) for kind in ("bigrams", "words")}
    if got["bigrams"].shape[1] != len(bigrams) or got["words"].shape[1] != len(block.hashes):
        raise RuntimeError("the input gave other blocks when a part of it was read again; write it to a table first")
    count = np.empty(len(bigrams))
    count[in_parts(*questions(block, bigrams, parts))] = got["bigrams"][0]
    c, s, ones, twos, rest, before = got["words"]
    low = d1[1] * of1[0] + d1[2] * of1[1] + d1[3] * more
    unigram = (before - d1[np.minimum(before, 3).astype(int)] + low / (v + 1)) / pairs if pairs else np.full(len(c), 1 / (v + 1))
    backoff = np.where(s > 0, (d2[1] * ones + d2[2] * twos + d2[3] * rest) / np.maximum(s, 1), 1.0)
    one, two = block.words(bigrams)
    p = np.log10((count - d2[np.minimum(count, 3).astype(int)]) / np.maximum(s, 1)[one] + backoff[one] * unigram[two])
    base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    add = lambda x: np.add.reduceat(x, block.first)
    columns = {"n_tokens": block.sizes, "n_known": add((c > 0).astype(np.int64)[block.tokens]), "base_score": add(base[block.tokens]), "score": add(p[np.searchsorted(bigrams, each)])}
    doc_id = pa.array(ids.view(np.int64), pa.int64(), mask=known == 0)
    return pa.table({"doc_id": doc_id, "held_out": block.held} | columns | {"train_tokens": np.full(len(ids), n, np.int64)}).select(SCORED)


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Parts at most: their numbers take two bytes.
MOST_PARTS = 1 << 16


class Model:
    """A stored model: its folder, the number of its parts, and its totals."""

    def __init__(self, spark: SparkSession, folder: str):
        tables = [spark.read.schema(ROWS).parquet(f"{folder}/{name}") for name in ("bigrams", "words")]
        self.shares = tables[0].where("kind in ('model', 'totals')").unionByName(tables[1])
        self.folder = folder
        sums = [np.zeros(4, np.int64), np.zeros(9, np.int64)]
        for part, payload in self.shares.where("kind = 'totals'").select("part", "payload").toLocalIterator():  # two rows a part
            sums[part] += np.frombuffer(payload, np.int64)
        self.totals = tuple(sums)
        self.parts = spark.read.parquet(f"{folder}/parts").first()[0]


def fit(docs: DataFrame, folder: str | None = None, block_bytes: int = BLOCK_BYTES) -> Model:
    """Counts a model from the texts of ``docs`` and stores it in ``folder``
    (by default a new one in the shared folder). Null and empty texts are one
    end token each, repeated rows count each; without rows the model is empty."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{scratch(spark)}/lm-{uuid.uuid4().hex}"
    docs = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // block_bytes), MOST_PARTS)
    put = lambda rows, name: rows.write.partitionBy("kind").option("compression", "none").parquet(f"{folder}/{name}")  # noqa: E731  payloads are packed

    def send(batches):
        yield from counted(batches, block_bytes, parts)

    put(docs.mapInArrow(send, ROWS).groupBy("part").applyInArrow(lambda t: add_bigrams(t, parts), ROWS), "bigrams")
    release(spark)
    added = spark.read.schema(ROWS).parquet(f"{folder}/bigrams").where("kind in ('words', 'sums')")
    put(added.groupBy("part").applyInArrow(add_words, ROWS), "words")
    spark.createDataFrame([(int(parts),)], "parts long").coalesce(1).write.parquet(f"{folder}/parts")
    for kind in ("words", "sums"):
        discard(spark, f"{folder}/bigrams/kind={kind}")  # they have gone into the words' shares
    release(spark)
    return Model(spark, folder)


def scored(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores each row of (doc_id, text, held_out) by a stored model: doc_id,
    held_out, n_tokens (with the end), n_known, train_tokens, base_score, score
    (log10 probabilities). Null and empty texts are one end token; repeated rows
    are scored each; an empty table gives none; a text of any length is whole in
    one block. Under an empty model every token has probability 1 / (V + 1) = 1."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    totals, parts = model.totals, model.parts

    def ask(batches):
        yield from asked(batches, block_bytes, parts)

    def texts(batches):
        yield from packed_texts(batches, block_bytes)

    both = docs.mapInArrow(ask, ROWS).unionByName(model.shares.where("kind <> 'totals'"))
    got = both.groupBy("part").applyInArrow(answers, ROWS)
    return docs.mapInArrow(texts, ROWS).unionByName(got).groupBy("block").applyInArrow(lambda t: score(t, totals, parts), SCHEMA)


def perplexities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores each row of (doc_id, text, held_out) by a model of those not held out."""
    return scored(docs, fit(docs.where("not held_out"), block_bytes=block_bytes), block_bytes)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return perplexities(docs.withColumn("held_out", remainder("doc_id", 5) == 1))
