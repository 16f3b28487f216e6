"""URL filter: rules first, then naive Bayes over segmented host names.

A host's labels are split into words by Viterbi under a unigram model of the
words in the pages' own texts; naive Bayes over these words and the path's
tokens, learned from the pages that a rule decides, judges the rest."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField

from .common import appended, octets, small_batches, table, written

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LONGEST = 24
BUCKETS = 1 << 14
SMOOTH = 0.5
MOST_LABELS = 200_000
TAGS = re.compile(rb"<[^>]*>")
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUNS = re.compile(r"[^\W\d_]+|\d+")


def parts(pages: DataFrame) -> DataFrame:
    """Adds host and path. A null url, or one without ``://``, has both empty."""
    rest = F.when(F.instr("url", "://") > 0, F.regexp_replace("url", r"(?s)^.*?://", "")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (the longest that fits; null: none) and its verdict."""
    rule = verdict = None
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return pages.withColumn("rule", rule).withColumn("verdict", verdict)


def substrings(pages: DataFrame) -> DataFrame:
    """What can be a word of a host: the substrings of the distinct hosts' letter runs."""

    def cut(batches):
        for batch in batches:
            for host in batch.column(0).to_pylist():
                runs = [r for label in host.split(".") for r in RUNS.findall(label) if not r.isdigit()]
                own = {r[i:j] for r in runs for i in range(len(r)) for j in range(i + 1, min(len(r), i + LONGEST) + 1)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], names=["word"])

    return pages.select("host").distinct().mapInArrow(cut, "word string").distinct()


def dictionary(pages: DataFrame, hosts: DataFrame) -> tuple[dict[str, float], float]:
    """Log probabilities of the words of all pages' visible texts, as far as a
    host has them, and that of the rarest of all words. All words stay in a table."""
    small_batches(pages.sparkSession)

    def count(batches):
        sums: Counter = Counter()
        for batch in batches:
            for html in octets(batch.column(0)):
                sums.update(TAGS.sub(b" ", html or b"").translate(LETTERS).split())
            if len(sums) > 1_000_000:
                yield out(sums)
                sums = Counter()
        yield out(sums)

    def out(sums):
        kept = [(w.decode(errors="replace"), n) for w, n in sums.items() if len(w) <= 4 * LONGEST]
        kept.append(("", sum(sums.values())))  # the total
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept]), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    counts = written(pages.select("html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")
    total = (counts.where("word = ''").agg(F.sum("n")).first()[0]) or 0
    words = counts.where((F.col("word") != "") & (F.length("word") <= LONGEST))
    rarest = words.agg(F.min("n")).first()[0]
    kept = words.join(substrings(hosts), "word", "left_semi").toLocalIterator()
    return {w: math.log(n / total) for w, n in kept}, math.log(rarest / total) if rarest else -1.0


class Segmenter:
    """Best words of a letter run; what the dictionary lacks costs by its length."""

    def __init__(self, words: dict[str, float], rarest: float | None = None):
        self.words, self.known = words, {}
        self.longest = max(map(len, words), default=1)
        self.unknown = (min(words.values(), default=-1.0) if rarest is None else rarest) - 1.0

    def split(self, run: str) -> list[str]:
        got = self.known.get(run)
        if got is None:
            if len(self.known) >= MOST_LABELS:
                self.known.clear()
            got = self.known[run] = self.viterbi(run)
        return got

    def viterbi(self, run: str) -> list[str]:
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - max(self.longest, LONGEST)), end):
                p = self.words.get(run[start:end])
                s = best[start] + (p if p is not None else self.unknown - 2.0 * (end - start))
                if s > best[end]:
                    best[end], back[end] = s, start
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        out = []
        for label in host.split("."):
            for run in RUNS.findall(label):
                out += ["h:#"] if run.isdigit() else ["h:" + w for w in self.split(run)]
        return out + ["p:#" if r.isdigit() else "p:" + r.lower() for r in RUNS.findall(path)]


def bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode()) % BUCKETS


def fit(judged: DataFrame, words: tuple[dict[str, float], float]):
    """Naive Bayes from the pages that have a verdict: log odds of a block, prior and by bucket."""
    shared = judged.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        segmenter, sums = Segmenter(*shared.value), np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums[int(verdict == "block")]
                own[BUCKETS] += 1
                for t in segmenter.tokens(host, path):
                    own[bucket(t)] += 1
        kind, at = sums.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(sums[kind, at])], names=["kind", "bucket", "n"])

    got = judged.where("verdict is not null").select("host", "path", "verdict").mapInArrow(count, "kind long, bucket long, n long")
    c = np.zeros((2, BUCKETS + 1))
    for kind, at, n in got.groupBy("kind", "bucket").agg(F.sum("n")).collect():  # 2 * BUCKETS rows at most
        c[kind, at] = n
    seen = np.log(c[:, :BUCKETS] + SMOOTH) - np.log((c[:, :BUCKETS] + SMOOTH).sum(1, keepdims=True))
    prior = np.log(c[:, BUCKETS] + SMOOTH)
    return float(prior[1] - prior[0]), seen[1] - seen[0]


def judged(pages: DataFrame, words: tuple[dict[str, float], float], model) -> DataFrame:
    """Adds tokens, block_odds (log odds) and the method's verdict where no rule
    decides; even odds allow."""
    shared = pages.sparkSession.sparkContext.broadcast((words, model))

    def make():
        words, (prior, odds) = shared.value
        segmenter = Segmenter(*words)

        def each(batch: pa.RecordBatch) -> list:
            rows = [segmenter.tokens(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            score = [prior + sum(float(odds[bucket(t)]) for t in row) for row in rows]
            verdicts = [v or ("block" if s > 0 else "allow") for v, s in zip(batch.column("verdict").to_pylist(), score)]
            return [pa.array(rows, pa.list_(pa.string())), pa.array(score, pa.float64()), pa.array(verdicts, pa.string())]

        return each

    return appended(pages, [StructField("tokens", ArrayType(StringType())), StructField("block_odds", DoubleType()), StructField("verdict", StringType())], make)


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule, tokens, block_odds and verdict to pages (url,
    html); columns of these names are replaced. Null, empty, repeated and very
    long urls are each judged whole; null html teaches no words; of rules of equal
    length the first by name is given; even odds, and so all pages where none is
    decided by a rule, are allowed; an empty table gives none."""
    rows = ruled(parts(pages.drop("html", "tokens", "block_odds")), rules)
    words = dictionary(pages, rows)
    return judged(rows, words, fit(rows, words))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
