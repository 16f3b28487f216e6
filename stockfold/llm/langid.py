"""Language identification: multinomial naive Bayes over hashed character
n-grams. Counts are summed in Spark, the log-probability matrix is broadcast,
texts are scored by gathering its rows. The matrix has BUCKETS rows and AT_ONCE
languages at most; more languages take more matrices, one after another."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import appended, remainder, small_batches, table, written

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Rows that the model is fitted on, about (a hash of the id chooses them).
FIT_ROWS = 40_000
#: Languages of one broadcast matrix (16 MB).
AT_ONCE = 64
PIECE = 1 << 18
SMOOTH = 0.1


@cache
def folds() -> np.ndarray:
    """Of each code point: its lower case if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def folded(text: str) -> np.ndarray:
    """Letters in lower case, anything between them as one space, a space at either end."""
    a = folds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    a = np.concatenate((a[:0], [32], a, [32])).astype(np.uint64)
    keep = a != 32
    keep[1:] |= a[:-1] != 32
    keep[0] = True
    return a[keep]


def buckets(letters: np.ndarray):
    """The bucket of every n-gram, piece by piece, so memory is bounded for any text."""
    for at in range(0, len(letters), PIECE):
        part = letters[at : at + PIECE + max(ORDERS) - 1]
        for n in ORDERS:
            m = min(PIECE, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ part[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


class Model:
    """Languages in order, their log priors, and a table of their counts (lang, bucket, n)."""

    def __init__(self, langs: list[str], prior: np.ndarray, counts: DataFrame | None):
        self.langs, self.prior, self.counts = langs, prior, counts

    def blocks(self, at_once: int):
        """(languages, log priors, matrix of buckets x languages), ``at_once`` languages each."""
        for k in range(0, len(self.langs), at_once):
            langs = self.langs[k : k + at_once]
            own = self.counts.where(F.col("lang").between(langs[0], langs[-1]) & (F.col("bucket") < BUCKETS)).toPandas()
            c = np.full((BUCKETS, len(langs)), SMOOTH)
            c[own["bucket"].to_numpy(int), np.searchsorted(langs, own["lang"].to_numpy(str))] += own["n"]
            yield langs, self.prior[k : k + at_once], np.log(c / c.sum(0))


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model from rows (doc_id, text, lang). Rows without text, letters or lang
    teach nothing; repeated rows teach each time. As the sample is about
    ``fit_rows`` rows, so are at most the languages."""
    rows = rows.where("lang is not null")
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    small_batches(rows.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters = folded(text or "")
                if len(letters) < 3:
                    continue
                if lang not in sums and len(sums) >= AT_ONCE:
                    yield out(sums)
                    sums = {}
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += 1
                for b in buckets(letters):
                    own[:BUCKETS] += np.bincount(b, minlength=BUCKETS)
        if sums:
            yield out(sums)

    def out(sums):
        at = [(lang, own.nonzero()[0]) for lang, own in sums.items()]
        lang = [x for x, places in at for _ in range(len(places))]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate([p for _, p in at])), pa.array(np.concatenate([sums[x][p] for x, p in at]))], names=["lang", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    counts = written(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "languages")
    docs = sorted((r.lang, r.n) for r in counts.where(F.col("bucket") == BUCKETS).collect())  # a row for each language
    n = np.array([x for _, x in docs], float)
    return Model([x for x, _ in docs], np.log(n / n.sum()), counts)


def identify(docs: DataFrame, model: Model, at_once: int = AT_ONCE) -> DataFrame:
    """Adds lang_pred and score (the posterior of that language); the text is
    dropped, columns of these names are replaced. A null text, one without
    letters, and any text under an empty model get ``und``, 0. Of languages with
    equal posteriors the first by name is given. Repeated rows get the same;
    texts of any length are read whole, piece by piece; an empty table gives none."""
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    # of the blocks before: the best language, its log odds, and the log of the sum of all odds
    state = [StructField("lang_pred", StringType()), StructField("_top", DoubleType()), StructField("_sum", DoubleType())]
    out = docs
    for number, block in enumerate(model.blocks(at_once)):
        shared, last = docs.sparkSession.sparkContext.broadcast(block), (number + 1) * at_once >= len(model.langs)

        def make(shared=shared, first=number == 0, last=last):
            langs, prior, logp = shared.value

            def each(batch: pa.RecordBatch) -> list:
                before = [(None, -np.inf, -np.inf)] * batch.num_rows if first else zip(*(batch.column(f.name).to_pylist() for f in state))
                got = []
                for text, (pred, top, total) in zip(batch.column("text").to_pylist(), before):
                    letters = folded(text or "")
                    if len(letters) < 3:
                        got.append((None, -np.inf, -np.inf))
                        continue
                    odds = prior.copy()
                    for b in buckets(letters):
                        odds += logp[b].sum(0)
                    k = int(odds.argmax())
                    total = np.logaddexp(total, odds[k] + np.log(np.exp(odds - odds[k]).sum()))
                    got.append((langs[k], odds[k], total) if odds[k] > top else (pred, top, total))
                if not last:
                    return [pa.array(c, f) for c, f in zip(zip(*got), (pa.string(), pa.float64(), pa.float64()))]
                return [pa.array([p or "und" for p, _, _ in got], pa.string()), pa.array([float(np.exp(t - s)) if p else 0.0 for p, t, s in got], pa.float64())]

            return each

        out = appended(out, fields if last else state, make, drop=("text", "_top", "_sum") if last else ())
    if model.langs:
        return out
    return docs.drop("text", "lang_pred", "score").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(docs.where("not held_out"))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
