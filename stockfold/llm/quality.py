"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE characters. A passage is encoded from
what kinds of characters it has, which follow which, and how much it repeats
itself; gated attention weighs the encoded passages, and the document's score
comes from their weighted mean. Encoder, attention and output are learned
together from document labels."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .common import appended, remainder, small_batches, table

PASSAGE = 512
#: Labelled rows, about, that the model is fitted on; fewer if together they have
#: more than FIT_CHARS characters. All passages of a chosen row count.
FIT_ROWS, FIT_CHARS = 4000, 1 << 26
HIDDEN, GATE = 24, 12
CUT = 0.3
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 other letter, 6 other, then each of PUNCTUATION.
KINDS = 7 + len(PUNCTUATION)
COARSE = 8
WIDTH = KINDS + COARSE * COARSE + 5


@cache
def kinds() -> np.ndarray:
    out = np.full(0x110000, 6, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        if c[0] == "L":
            out[i] = {"Ll": 0, "Lu": 1, "Lt": 1}.get(c, 5)
        elif c[0] == "N":
            out[i] = 2
        elif c == "Zs":
            out[i] = 3
    out[9], out[10], out[13] = 3, 4, 4
    for k, c in enumerate(PUNCTUATION):
        out[ord(c)] = 7 + k
    return out


def encode(text: str | None) -> np.ndarray:
    """Features of each passage. An empty text has one passage of zeros."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((max(1, -(-len(codes) // PASSAGE)), WIDTH), np.float32)
    for k in range(len(out)):
        part = codes[k * PASSAGE : (k + 1) * PASSAGE]
        if len(part):
            out[k] = passage(part)
    return out


def passage(part: np.ndarray) -> np.ndarray:
    kind = kinds()[part]
    n = len(part)
    coarse = np.minimum(kind, COARSE - 1).astype(np.int64)
    after = np.bincount(coarse[:-1] * COARSE + coarse[1:], minlength=COARSE * COARSE) / max(1, n - 1)
    grams = part[:-3].astype(np.uint64) << np.uint64(42) ^ part[1:-2].astype(np.uint64) << np.uint64(28) ^ part[2:-1].astype(np.uint64) << np.uint64(14) ^ part[3:]
    grams.sort()
    edges = np.concatenate(([0], np.diff(grams).nonzero()[0] + 1, [len(grams)]))
    run = np.diff(edges) if len(grams) else np.ones(1)
    gaps = (kind == 3).sum() + (kind == 4).sum()
    more = (len(run) / max(1, len(grams)), run.max() / max(1, len(grams)), np.log1p(n) / 7, gaps / n, min(1.0, (kind == 4).sum() * 20 / n))
    return np.concatenate((np.sqrt(np.bincount(kind, minlength=KINDS) / n), np.sqrt(after), more))


def forward(w: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, bags: int):
    """Scores of bags; ``bag`` tells the bag of each passage, in order. No bag is empty."""
    start = np.searchsorted(bag, np.arange(bags))
    h = np.tanh(x @ w["enc"] + w["enc0"])
    t, g = np.tanh(h @ w["tan"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    e = (t * g) @ w["att"]
    a = np.exp(e - np.maximum.reduceat(e, start)[bag])
    a /= np.add.reduceat(a, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start)
    p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"], -60, 60)))
    return p, (h, t, g, a, z)


def backward(w, x, bag, bags, y, p, kept):
    h, t, g, a, z = kept
    dz_out = (p - y) / bags
    grad = {"out": z.T @ dz_out, "out0": np.array(dz_out.sum())}
    dz = dz_out[:, None] * w["out"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.bincount(bag, a * da, bags)[bag])
    dh = a[:, None] * dz[bag]
    grad["att"] = (t * g).T @ de
    dt, dg = de[:, None] * w["att"] * g * (1 - t * t), de[:, None] * w["att"] * t * g * (1 - g)
    grad["tan"], grad["gate"] = h.T @ dt, h.T @ dg
    dh = (dh + dt @ w["tan"].T + dg @ w["gate"].T) * (1 - h * h)
    grad["enc"], grad["enc0"] = x.T @ dh, dh.sum(0)
    return grad


def learn(bags: list[np.ndarray], labels: list[int], rounds: int = 250, rate: float = 0.01, seed: int = 7):
    """Weights by Adam over all bags; None if a label is missing."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    x, bag = np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    mean, spread = x.mean(0), x.std(0) + 0.01
    x = np.clip((x - mean) / spread, -6, 6)
    shape = {"enc": (WIDTH, HIDDEN), "enc0": HIDDEN, "tan": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "att": GATE, "out": HIDDEN, "out0": ()}
    w = {k: rng.normal(0, 0.15, s) if k not in ("enc0", "out0") else np.zeros(s) for k, s in shape.items()}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        p, kept = forward(w, x, bag, len(bags))
        for k, g in backward(w, x, bag, len(bags), y, p, kept).items():
            g = g + 1e-4 * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "spread": spread}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS):
    """Model from documents and rows (doc_id, label). Rows with a null label
    teach nothing; a document with several labels has their rounded mean, rows
    that repeat a document teach once. Above ``fit_rows`` rows or ``fit_chars``
    characters a hash of the rows chooses which of them teach."""
    labels = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = labels.count()
    if n > fit_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    # the labels are now about fit_rows, a fixed number of ids
    rows = rows.join(F.broadcast(labels), "doc_id").select("text", "label").distinct()
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(1_000_000)))
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    share = min(1.0, fit_rows * 1.5 / max(n, 1), fit_chars / max(chars or 0, 1))  # half as many again, as ids may be shared
    if share < 1:
        rows = rows.where(F.col("_h") < int(1e6 * share))
    small_batches(docs.sparkSession)

    def encoded(batches):
        for batch in batches:
            made = [encode(t).astype("<f4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["bag", "label"])

    got = rows.select("text", "label").mapInArrow(encoded, "bag binary, label int").toPandas().sort_values(["label", "bag"])
    return learn([np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in got["bag"]], got["label"].tolist())


def scored(docs: DataFrame, model) -> DataFrame:
    """Adds score and predicted (1 from a score of CUT on); columns of these names
    are replaced. All passages of a text count, however long it is. Null and
    empty texts are one empty passage; repeated rows get the same; without a
    model (no labels, or of one kind only) every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        w = shared.value

        def one(text):
            if w is None:
                return 0.5
            x = np.clip((encode(text) - w["mean"]) / w["spread"], -6, 6)
            return float(forward(w, x, np.zeros(len(x), int), 1)[0][0])

        def each(batch: pa.RecordBatch) -> list:
            scores = [one(t) for t in batch.column("text").to_pylist()]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())]

        return each

    return appended(docs, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], make)


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.where(remainder("doc_id", 5) != 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 5) == 0)
    return scored(docs, fit(docs, label_rows(spark, sf_dir))).select("doc_id", "held_out", "score", "predicted")
