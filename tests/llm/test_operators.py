"""Each operator on a small fixture with nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns with clashing names, against brute
force where SQL has no equivalent."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
import xxhash
from pyspark.sql import functions as F
from stockfold.llm import bpe, chat, common, decontaminate, exact_dedup, langid, lm, quality, sharding, simhash, urls
from stockfold.llm.common import remainder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, score string, Kept string, spans string, fp string, content string"
WORDS = "the house stands on a hill über été ñandú naïve in rain 42 and Wind".split()


def texts(seed=3, n=60):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    out += [None, "", " \t\n", "one", "  two words ", out[0], out[0], out[0].upper(), out[1] + " tail", "x" * 3000, "long words " * 4000, "é" * 2000 + "🙂 \x1c z"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    made = [(i, x, "en" if i % 2 else None, "s", "k", "q", "f", "c") for i, x in enumerate(t)]
    return [*made, (None, "no id", "de", "s", "k", "q", "f", "c"), made[5], (7, None, "en", "s", "k", "q", "f", "c")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_many_languages(spark):
    """More languages than one matrix takes, and a sample: as a plain version says."""
    rng = random.Random(1)
    alphabets = {f"l{k:02}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéñçø", 9)) for k in range(11)}
    made = [(i, " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(12)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 12)]
    docs = spark.createDataFrame([*made, (None, made[0][1], None), (990, None, "l00"), (991, "", None), (992, "!?", "l03")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    key = lambda r: (r.doc_id or -1, r.lang_pred, round(r.score, 9))
    got = [sorted(map(key, langid.identify(docs, model, at_once).collect())) for at_once in (64, 4, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == docs.count()
    # brute force: counts by language, Bayes by hand
    grams = lambda t: np.concatenate(list(langid.buckets(langid.folded(t))))
    c = {x: np.full(langid.BUCKETS, langid.SMOOTH) for x in alphabets}
    n = collections.Counter()
    for _, t, lang in made:
        np.add.at(c[lang], grams(t), 1)
        n[lang] += 1
    for i, t, _ in made[:40]:
        odds = np.array([math.log(n[x] / sum(n.values())) + np.log(c[x] / c[x].sum())[grams(t)].sum() for x in sorted(alphabets)])
        p = np.exp(odds - odds.max())
        want = (sorted(alphabets)[int(odds.argmax())], float(p.max() / p.sum()))
        mine = next(x for x in got[0] if x[0] == (i or -1) or (i == 0 and x[0] == -1))
        assert i == 0 or (mine[1], mine[2]) == (want[0], pytest.approx(want[1], abs=1e-8))
    sampled = langid.fit(docs, 40)
    assert 0 < len(sampled.langs) <= 11 and langid.identify(docs, sampled).count() == docs.count()


def test_language(spark, docs, none):
    german = [(i, "der hund und die katze schlafen nicht " * (1 + i % 3), "de") for i in range(40)]
    english = [(100 + i, "the dog and the cat never sleep " * (1 + i % 3), "en") for i in range(40)]
    train = spark.createDataFrame([*german, *english, (900, None, "en"), (901, "no lang", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(1, "die katze und der hund"), (2, "THE CAT and dog"), (3, None), (4, "12 !?"), (5, "")], "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["de", "en", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    assert langid.identify(docs, model).count() == docs.count()
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
    # n-grams of a text are the same in pieces
    a = langid.folded("ab cd" * 100)
    whole = np.concatenate([np.sort(b) for b in langid.buckets(a)])
    piece, langid.PIECE = langid.PIECE, 64
    try:
        parts = np.concatenate(list(langid.buckets(a)))
    finally:
        langid.PIECE = piece
    assert sorted(parts) == sorted(whole)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontaminate(spark, docs, rows, none, block_words):
    items = [(1, " ".join((rows[3][1] or "").split()[2:16])), (2, "ONE"), (3, None), (4, ""), (None, "house"), (5, "two, words"), (10, rows[8][1]), (6, "rain rain rain"), (6, "the house")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, block_words=block_words)
    mine = sorted((r.doc_id or -1, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in got.collect())
    want = sorted((w[0] or -1, *w[1:]) for w in decontaminate.brute([(r[0], r[1]) for r in rows], [i for i in items if i[0] is not None]))
    assert mine == want
    assert "score" in got.columns and got.columns.count("spans") == 1
    assert decontaminate.contamination(none, bench).count() == 0
    assert not any(r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).select("n_hit").collect())


def test_benchmark_of_long_and_repeated_items(spark, docs, rows, monkeypatch):
    """Blocks stay small, and every window is in one of them."""
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 5)
    rng = random.Random(2)
    long = " ".join([*(rng.choice(WORDS) for _ in range(400)), rows[3][1]])
    items = [(1, long), *[(2, "the house stands")] * 500, (3, "x" * 2000), (4, rows[8][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes = [sum(map(len, b.windows)) for b in decontaminate.blocks(bench, 10, 60, True)]
    assert len(sizes) > 4 and max(sizes) < 10 * 60 * 4
    got = decontaminate.contamination(docs, bench, block_words=150, unnamed=True)
    mine = sorted((r.doc_id or -1, r.n_words, r.n_hit, len(r.item_ids)) for r in got.collect())
    assert mine == sorted((w[0] or -1, *w[1:4]) for w in decontaminate.brute([(r[0], r[1]) for r in rows], list(dict.fromkeys(items))))


@pytest.mark.parametrize("block_words", [200_000, 1])
def test_items_without_id_hit(spark, tmp_path, block_words):
    docs = spark.createDataFrame([(1, "a house"), (2, "rain and rain"), (3, "wind")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "house"), (5, "rain"), (None, "rain"), (6, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.contamination(docs, items, block_words=block_words, unnamed=True).collect()}
    assert got == {1: (1, [], True), 2: (2, ["5"], True), 3: (0, [], False)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.op2_decontaminate(spark, str(tmp_path)).collect()} == {1: (1, 0), 2: (2, 1), 3: (0, 0)}


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET, 2000])
def test_exact(spark, docs, rows, none, budget):
    got = exact_dedup.verdicts(docs, budget).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in got:
        ids = sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(by)
    kept = exact_dedup.survivors(docs, budget)
    assert kept.columns == docs.columns and kept.count() == len(by)
    assert exact_dedup.verdicts(none).count() == exact_dedup.survivors(none).count() == 0


def test_hot_groups_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "DEALT", 3)
    monkeypatch.setattr(exact_dedup, "CHUNK", 4)
    rows = [(i, "one two three four five six" if i % 3 == 0 else f"text {i} is alone {i * i}") for i in range(90)]
    rows += [(None, "one two three four five six"), (0, "one two three four five six"), *[(87, "one two three four five six")] * 11, *[(None, "no id at all")] * 9]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.verdicts(docs).collect()
    hot = [r for r in got if r.group_size > 9]
    assert len(got) == len(rows) and len(hot) == 43 and {r.keep_id for r in hot} == {87} and {r.group_size for r in hot} == {43}
    assert [r.doc_id for r in hot if r.kept] == [87] and sum(r.kept for r in got) == 62
    assert sum(r.kept for r in got if r.group_size == 9) == 1
    near = simhash.groups(docs).collect()
    assert len(near) == len(rows) and sum(r.component_id == 0 for r in near) == 43
    assert sum(r.component_id is None for r in near) == 9


def test_one_of_each_group_is_first(spark):
    rows = [(5, "a b c d e f g h", "k1"), (None, "A b c d e f g h", "k0"), (5, "a B c d e f g h", "k2"), (None, "x y", "k3"), (None, "X y", "k4"), (9, None, "k5"), (8, "", "k6")]
    got = {r.key: r for r in simhash.grouped(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()}
    assert sorted(k for k, r in got.items() if r.first) == ["k1", "k3", "k6"]
    assert got["k0"].component_id == 5 and got["k4"].component_id is None and got["k5"].component_id == 8


def test_a_digest_names_one_content(monkeypatch):
    class Short:
        def __init__(self, data):
            self.data = data

        def digest(self):
            return self.data[:1] * 32

    monkeypatch.setattr(exact_dedup.hashlib, "sha256", Short)
    b = exact_dedup.Bucket()
    b.add(1, b"ab", 1, b"")
    with pytest.raises(ValueError):
        b.add(1, b"ac", 2, b"")


def test_spill_files_go(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    b, rng = exact_dedup.Bucket(4000), random.Random(1)
    want = collections.Counter()
    for i in range(3000):
        t = rng.randbytes(rng.randint(1, 2)) * 20
        want[t] += 1
        b.add(xxhash.xxh64_intdigest(t), t, i, b"")
    assert any(tmp_path.iterdir())
    assert {c: n for _, c, _, _, n in b.results()} == want
    assert not any(tmp_path.iterdir())


def brute_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
            up[find(j)] = find(i)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        low[find(i)].append(d)
    return [min((d for d in low[find(i)] if d is not None), default=None) for i in range(len(pairs))]


@pytest.mark.parametrize("block,level", [(1 << 14, None), (4, 1), (1 << 14, 2), (1 << 14, 3)])
def test_simhash(spark, docs, rows, none, block, level):
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = sorted((str(d), f, c) for (d, f), c in zip(fps, brute_components(fps)))
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(docs, block, level).collect())
    assert got == want
    if level is None:
        assert simhash.groups(none).count() == 0


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_pigeonring_loses_nothing(level):
    rng, made = random.Random(level), simhash.keys(level)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        hits = [i for i, m in made if a & m == b & m and len(simhash.near(np.uint64(a), np.array([b], np.uint64), i))]
        assert hits


def test_dense_group_stays_connected(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps)[:3]:
        fps |= {f ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (64, 1 << 14):
        roots = simhash.components(simhash.links(frame, block, 1))
        assert roots.groupBy("root").count().where("count > 200").count() == 3
        assert simhash.links(frame, 1 << 14, 1).count() < 15 * len(fps)


def test_language_model(spark, docs, rows, none):
    held = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False)))
    tok = [[*re.findall("[^\x20\x09-\x0d]+", (r[1] or "").translate(LOWER)), "\n"] for r in rows]
    train = [t for t, r in zip(tok, rows) if r[0] is None or r[0] % 3 != 1]
    c1 = collections.Counter(x for t in train for x in t)
    c2 = collections.Counter(x for t in train for x in zip([" ", *t], t))
    n, v, before = sum(c1.values()), len(c1), collections.Counter(b for _, b in c2)
    of = lambda c: lm.discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4)))
    d1, d2 = of(before), of(c2)
    low, total, gap = sum(d1[min(x, 3)] for x in before.values()), collections.Counter(), collections.Counter()
    for (a, _), x in c2.items():
        total[a] += x
        gap[a] += d2[min(x, 3)]

    def p(a, b):
        u = (before[b] - d1[min(before[b], 3)] + low / (v + 1)) / sum(before.values())
        return (c2[a, b] - d2[min(c2[a, b], 3)] + gap[a] * u) / total[a] if total[a] else u

    assert abs(sum(p("the", w) for w in [*c1, "unseen"]) - 1) < 1e-9
    want = sorted((len(t), sum(c1[x] > 0 for x in t), n, round(sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 6), round(sum(math.log10(p(a, b)) for a, b in zip([" ", *t], t)), 6)) for t in tok)
    for size in (lm.BLOCK_BYTES, 3000):
        got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.perplexities(held, size).collect())
        assert got == want
    assert lm.perplexities(none.withColumn("held_out", F.lit(False))).count() == 0
    untaught = lm.perplexities(held.withColumn("held_out", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in untaught)


def test_stored_model(spark, docs, tmp_path):
    """A stored model scores other texts as it did, and its shares are sorted arrays of hashes."""
    rows = docs.select("doc_id", "text").withColumn("held_out", F.lit(True))
    made = lm.fit(docs, f"{tmp_path}/lm", 3000)
    again = lm.Model(spark, f"{tmp_path}/lm")
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score)
    assert sorted(map(key, lm.scored(rows, made).collect())) == sorted(map(key, lm.scored(rows, again, 500).collect()))
    seen = 0
    for r in again.shares.where("kind in ('model', 'words')").collect():
        hashes = np.cumsum(lm.unpack(bytes(r.payload))[0], dtype=np.uint64)
        assert (np.diff(hashes.astype(object)) > 0).all()
        seen += len(hashes) * (r.kind == "words")
    words = {w for t in docs.select("text").collect() for w in re.findall("[^\x20\x09-\x0d]+", (t.text or "").translate(LOWER))}
    assert seen == len(words) + 2  # the end, and what stands before a text
    assert {r.kind for r in again.shares.select("kind").distinct().collect()} == {"model", "words", "totals"}
    other = lm.scored(spark.createDataFrame([(1, "the house unseen", True)], "doc_id long, text string, held_out boolean"), again).first()
    assert (other.n_tokens, other.n_known) == (4, 3)


def test_packets_grow_with_the_input(spark):
    """What fitting gathers, in bytes, is in proportion to the input."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    sizes = []
    for n in (40, 160):
        docs = spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string").coalesce(1)
        rows = docs.select("doc_id", "text", F.lit(False).alias("held_out"))
        got = rows.mapInArrow(lambda batches: lm.counted(batches, 20_000, 8), lm.ROWS)
        sizes.append(got.agg(F.sum(F.length("payload"))).first()[0])
    assert 3.5 < sizes[1] / sizes[0] < 4.5


def test_words_of_near_hashes(spark):
    """Two pairs of words whose 64-bit hashes have the upper 40 bits in common."""
    pairs = [("w160904", "w796784"), ("w1204313", "w2056576")]
    assert all(xxhash.xxh3_64_intdigest(a) >> 24 == xxhash.xxh3_64_intdigest(b) >> 24 for a, b in pairs)
    rows = [(0, f"{pairs[0][0]} {pairs[1][0]} {pairs[1][1]}", False), (1, pairs[0][1], True)]
    got = {r.doc_id: r for r in lm.perplexities(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert (got[0].n_known, got[1].n_known) == (4, 1)  # with the end
    v, n = 4, 4
    assert got[1].base_score == pytest.approx(math.log10(0.5 / (n + 0.5 * (v + 1))) + math.log10(1.5 / (n + 0.5 * (v + 1))))


def test_quality(spark, docs, none):
    rng = random.Random(2)
    good = [(i, ". ".join(" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(rng.randint(2, 80))), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(rng.randint(20, 400))), 0) for i in range(120)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, label int")
    model = quality.fit(frame.select("doc_id", "text"), frame.where("doc_id % 5 <> 0").select("doc_id", "label"))
    got = quality.scored(frame, model).where("doc_id % 5 = 0").collect()
    assert all(r.predicted == r.label for r in got)
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, model).select("score").collect())
    # a sample of rows, by number and by characters, and repeated labels and documents
    for some in (quality.fit(frame, frame, fit_rows=60), quality.fit(frame, frame, fit_chars=60_000), quality.fit(frame.union(frame), frame.union(frame))):
        right = [r.predicted == r.label for r in quality.scored(frame, some).collect()]
        assert sum(right) > 0.95 * len(right)
    nothing = quality.fit(none, frame.select("doc_id", "label").limit(0))
    assert nothing is None and {r.score for r in quality.scored(docs, nothing).select("score").collect()} == {0.5}


def test_gradient():
    rng = np.random.default_rng(1)
    x, bag, y = rng.normal(size=(7, quality.WIDTH)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0, 1])
    shape = {"enc": (quality.WIDTH, quality.HIDDEN), "enc0": quality.HIDDEN, "tan": (quality.HIDDEN, quality.GATE), "gate": (quality.HIDDEN, quality.GATE), "att": quality.GATE, "out": quality.HIDDEN, "out0": ()}
    w = {k: rng.normal(0, 0.3, s) for k, s in shape.items()}
    loss = lambda: -(y * np.log(p := quality.forward(w, x, bag, 3)[0]) + (1 - y) * np.log(1 - p)).mean()
    p, kept = quality.forward(w, x, bag, 3)
    grad = quality.backward(w, x, bag, 3, y, p, kept)
    for k in w:
        flat = w[k].reshape(-1) if w[k].shape else None
        if flat is None:
            continue
        old = flat[3]
        flat[3] = old + 1e-5
        up = loss()
        flat[3] = old - 1e-5
        down = loss()
        flat[3] = old
        assert abs((up - down) / 2e-5 - grad[k].reshape(-1)[3]) < 1e-6


def least_cost(roles):
    """Shortest path over the whole conversation, by plain search."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for label in range(3):
                change = 0 if r == chat.ROLES[label] else chat.RELABEL if r in chat.ROLES else chat.RELABEL_UNKNOWN
                for cost, ok in ((0, label in chat.NEXT[s]), (chat.MERGE, label == s), (chat.INSERT, any(label in chat.NEXT[x] for x in chat.NEXT[s]))):
                    if ok:
                        new[label] = min(new.get(label, 99999), c + change + cost)
        best = new
    return min(c + chat.CLOSE[s][0] for s, c in best.items())


def legal(rendered):
    heads = re.findall(r"<\|(system|user|assistant)\|>", rendered)
    body = heads[1:] if heads[0] == "system" else heads
    return body == ["user", "assistant"] * (len(body) // 2) and len(body) >= 2


def test_chat(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), f"t{c}-{t}") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(["user", "assistant", "system"]), None if t == 5 else f"x{t}") for t in range(70)]
    rows += [(None, 0, "user", "a"), (1, None, "user", "late"), rows[0], (2, 0, "user", "tie"), (2, 0, "user", "tie 2")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, blk int")
    out = {}
    for block in (chat.BLOCK, 8):
        monkeypatch.setattr(chat, "BLOCK", block)
        got = sorted((r.conv_id if r.conv_id is not None else -1, r.blk, r.seq, r.role, r.action, r.out_role, r.inserted, r.ended, r.piece) for r in chat.formatted(turns).collect())
        for conv, own in itertools.groupby(got, key=lambda r: r[0]):
            own = list(own)
            assert legal("".join(r[8] for r in own))
            cost = sum((chat.RELABEL if r[3] in chat.ROLES else chat.RELABEL_UNKNOWN) * ("relabel" in r[4]) + chat.MERGE * ("merge" in r[4]) + chat.INSERT * (r[6] is not None) + chat.INSERT * len((r[7] or "").split(",") if r[7] else []) for r in own)
            assert cost == least_cost([r[3] for r in own])
        out[block] = len(got)
        assert len(got) == len(set(rows)) and sum(r.n for r in chat.formatted(turns).collect()) == len(rows)
    assert chat.formatted(turns.limit(0)).count() == 0


def test_crowded_conversation(spark, monkeypatch):
    """Rows without conv_id, many texts of one number and equal rows without a number."""
    monkeypatch.setattr(chat, "BLOCK", 8)
    monkeypatch.setattr(chat, "MOST_TURNS", 20)
    rng = random.Random(6)
    rows = [(None, rng.randrange(3), rng.choice(["user", "assistant"]), f"t{k}") for k in range(150)]
    rows += [(7, None, "assistant", "yes")] * 30 + [(7, 0, "user", "well?")] + [(8, k, "user", "a") for k in range(3)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and len({tuple(r.blk) for r in got if r.conv_id is None}) > 10
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.blk, r.seq)):
        by[r.conv_id].append(r)
    for own in by.values():
        assert legal("".join(r.piece for r in own))
        numbers = [math.inf if r.turn is None else r.turn for r in own]
        assert numbers == sorted(numbers)
        cost = sum(chat.RELABEL * ("relabel" in r.action) + chat.MERGE * ("merge" in r.action) + chat.INSERT * (r.inserted is not None) + chat.INSERT * len((r.ended or "").split(",") if r.ended else []) for r in own)
        assert cost == least_cost([r.role for r in own])


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe(spark, docs, rows, none, ranks):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, decoder, rng = bpe.Encoder(ranks, P.PATTERN), bpe.Decoder(ranks), random.Random(9)
    alphabet = "aaabcdeinostr  '.,\n\t0123éñß中文字🙂\u0301\u200b"
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    cases += ["".join(rng.choice("abcdefghij") for _ in range(3000)), "é" * 500, "<|endoftext|>", "\ufffd", "ab" * 5000, "the" * 3000, " " * 999]
    for t in cases:
        ids = theirs.encode_ordinary(t)
        assert list(mine.encode(t)) == ids
        assert decoder.decode(ids) == t
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decoded(bpe.encoded(docs, path, P.PATTERN), path).select("text", "ids", "decoded").collect()
    for r in got:
        assert r.ids == np.array(theirs.encode_ordinary(r.text or ""), "<u4").tobytes() and r.decoded == (r.text or "")
    assert len(got) == len(rows) and bpe.digests(none).count() == 0
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(str(r.doc_id), len(r.ids) // 4, sha(r.ids), sha(r.decoded.encode())) for r in bpe.encoded(docs, path, P.PATTERN, back=True).collect()]
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.digests(docs).collect()) == sorted(want)


def test_utf8_machine(ranks):
    decoder, rng = bpe.Decoder(ranks), random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice([rng.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 65]) for _ in range(rng.randint(0, 12)))
        ids = [ranks[data[i : i + 1]] for i in range(len(data))]
        assert decoder.decode(ids) == data.decode(errors="replace")


@pytest.mark.parametrize("name,most", [("MOST_TRANSITIONS", 20), ("MOST_PATHS", 15), ("FEW", 0), ("FEW", 3)])
def test_transducer_with_small_tables(ranks, monkeypatch, name, most):
    """What a table holds, and which states are told apart, changes no token."""
    monkeypatch.setattr(bpe, name, most)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, rng = bpe.Encoder(ranks, P.PATTERN), random.Random(6)
    for t in ["qwertzuiopasdfghjkl" * 50, " " * 300, "é中" * 99, *("".join(rng.choice("aeirstñ中 ") for _ in range(60)) for _ in range(40))]:
        assert list(mine.encode(t)) == theirs.encode_ordinary(t)


def test_pieces_run_through_the_transducer(ranks, monkeypatch):
    """Each distinct piece that is not a token takes one run over all its bytes."""
    mine, ran = bpe.Encoder(ranks, P.PATTERN), []
    run = mine.transduce
    monkeypatch.setattr(mine, "transduce", lambda data: ran.append(data) or run(data))
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeinorstuéß") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    text = " ".join(words * 2)
    mine.encode(text)
    pieces = {x.encode() for x in mine.pattern.findall(text)}
    assert sorted(ran) == sorted(x for x in pieces if x not in ranks)
    # from then on all transitions are there
    made = len(mine.go)
    mine.pieces.clear()
    mine.pieces.before = {}
    mine.encode(text)
    assert len(mine.go) == made
    # a token leaves at the latest when no token could go on from its end: the output still held back is short
    longest = max(map(len, ranks))
    assert all(len(mine.tokens(x & 0xFFFFF)) <= longest for live in mine.states for x in live)


def test_tables_that_overflow(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 7)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 5)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, rng = bpe.Encoder(ranks, P.PATTERN), random.Random(5)
    words = ["".join(rng.choice("aeirstñ中") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    for _ in range(200):
        t = " ".join(rng.choices(words, k=12))
        assert list(mine.encode(t)) == theirs.encode_ordinary(t)
    assert len(mine.pieces) <= 7 and len(mine.pieces.before) <= 7 and len(mine.pairs) <= 5


@pytest.mark.parametrize("cell", [sharding.CELL, 3])
def test_sharding(spark, docs, rows, none, cell):
    got = sharding.shuffled(docs.select("doc_id", "text", F.lit("z").alias("slot")), 16, cell=cell).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert {len(s) for s in by.values()} <= {len(rows) // 16, len(rows) // 16 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shuffled(none, 16, cell=cell).count() == 0
    odd = docs.select("doc_id", F.lit("c").alias("_cell"), F.lit(1).alias("_order"), F.lit(2).alias("_at"), F.lit(3).alias("Shard"), F.create_map(F.lit("a"), F.lit(1)).alias("a.map"))
    got = sharding.shuffled(odd, 3, cell=cell)
    assert got.columns == ["doc_id", "_cell", "_order", "_at", "a.map", "shard", "slot"] and got.count() == len(rows)
    assert {(r[1], r[2], r[3], r[4]["a"]) for r in got.collect()} == {("c", 1, 2, 1)}


def test_matrix_is_uniform():
    counts, sizes = np.array([5, 0, 9, 6]), np.array([7, 7, 6])
    sums = np.zeros((4, 3))
    for seed in range(600):
        m = np.array([sharding.row_of_matrix(counts, sizes, p, seed) for p in range(4)])
        assert (m.sum(0) == sizes).all() and (m.sum(1) == counts).all()
        sums += m
    assert np.abs(sums / 600 - np.outer(counts, sizes) / 20).max() < 0.2
    big = sharding.split(np.random.default_rng(1), np.array([10**9, 2 * 10**9, 5]), 10**9)
    assert big.sum() == 10**9 and abs(big[0] - 10**9 // 3) < 10**6


def test_urls(spark):
    cases = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        ("http://m.example.com/de/x.html", "m.example.com", "/de/x.html", "example.com/de/", "block"), ("x://b.org/fr/?a", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://b.org/FR/", "b.org", "/FR/", None, None), ("http://c.net", "c.net", "", None, None), ("http://c.net?a/b", "c.net", "", None, None),
        (None, "", "", None, None), ("", "", "", None, None), ("a.net/x", "", "", None, None), ("a://b://c.net/d", "b:", "//c.net/d", None, None), ("http://ÄB.net/", "Äb.net", "/", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, None if i == 3 else "<p>house wind rain</p> house <b>the</b>", "x") for i, (u, *_) in enumerate(cases)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in urls.filtered(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.filtered(pages.limit(0)).count() == 0
    unruled = urls.filtered(pages.where("page_id = 3"))
    assert [r.verdict for r in unruled.collect()] == ["allow"]


def test_rare_words_split_hosts(spark):
    pages = spark.createDataFrame([(1, "http://cheappills.com/", "filler " * 200_000), (2, "", "<p>cheap</p> pills")], "page_id long, url string, html string")
    got = {r.page_id: r.tokens for r in urls.filtered(pages).collect()}
    assert got[1] == ["h:cheap", "h:pills", "h:com"]


def test_segmentation():
    words = {w: math.log(1 / 5) for w in ("rain", "house", "wind", "in", "the")}
    s = urls.Segmenter(words)
    assert s.split("rainhouse") == ["rain", "house"] and s.split("thewind") == ["the", "wind"] and s.split("") == []
    assert s.split("xqrain")[-1] == "rain"
    assert s.tokens("m.windhouse-7.org", "/en/12") == ["h:m", "h:wind", "h:house", "h:#", "h:org", "p:en", "p:#"]


def test_remainder(spark):
    frame = spark.createDataFrame([(1,), (77,), (None,)], "doc_id long").select("doc_id", remainder("doc_id", 4).alias("r"))
    assert all(r.r == zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 for r in frame.collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda k: ". ".join(" ".join(rng.choice(WORDS) for _ in range(11)) for _ in range(k))
    rows = [(i, prose(rng.randint(3, 20)), "en", "s", 1) for i in range(150)]
    junk = [(500 + i, " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(150)), "en", "s", 1) for i in range(60)]
    item = " ".join(rng.choice(WORDS) + str(k) for k in range(20))
    near = rows[4][1] + " end"
    extra = [(700, rows[3][1], "en", "s", 1), (701, rows[9][1] + " " + item, "en", "s", 1), (702, near, "en", "s", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + junk + extra, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], int(r[0] < 500), 0) for r in rows + junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(500 <= i < 560 for i in got)
    assert 3 not in got and 700 in got and 701 not in got
    # stages by brute force, each on what the one before kept
    kept = [r for r in rows + extra if r[0] != 3 and (r[0] in got or r[0] in (701, 702, 4))]
    fps = [(r[0], brute_fingerprint(r[1])) for r in kept]
    alone = {d for (d, _), c in zip(fps, brute_components(fps)) if d == c}
    hit = {w[0] for w in decontaminate.brute([(r[0], r[1]) for r in kept], [(1, item)]) if w[5]}
    assert set(got) == alone - hit
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    assert all(got[r[0]].n_tokens == len(theirs.encode_ordinary(r[1])) for r in kept if r[0] in got)
