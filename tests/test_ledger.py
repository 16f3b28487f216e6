"""The ledger against DuckDB, a sequential model and hand-made cases."""

import itertools
import json
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from stockfold import catalog
from stockfold.functions.scalar import fingerprint, reason
from stockfold.operators import ledger, reads
from stockfold.plans import observe, replay
from stockfold.operators import log as log_ops
from stockfold.schema import FIELDS
from stockfold.sources import binary, files
from stockfold.streaming import ingest as streaming
from stockfold.streaming.store import Store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
OP = "operation_id string, owner_id string, sku string, delta long, event_version long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(names).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory):
    """The small events, some with movements that a request must not have: none, and too large ones."""
    folder = tmp_path_factory.mktemp("odd")
    value = "CASE WHEN event_id IN (3, 750, 850, 851) THEN 0 WHEN event_id IN (4, 760) THEN 2e7 ELSE value END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["q_json_batches", "q_log_tail", "q_replay_lines"])
def test_lines_with_invalid_operations_equal_sql(spark, odd_events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd_events}/events.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, catalog.QUERIES[name](spark, odd_events).select(names).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)


def random_log(rng):
    log, epoch = [], 0
    for n in range(120):
        kind = rng.choices(["fence", "poison", "operations"], [1, 1, 8])[0]
        if kind == "fence":
            e = epoch + rng.choice([-1, 1, 1, 2])
            epoch = max(epoch, e)
        else:
            e = None if kind == "poison" else epoch + rng.choice([0, 0, 0, 0, -1, 1])
        i = rng.randrange(60)
        log.append((n, kind, e, f"op{i}", f"o{i % 4}", f"s{i % 3}", i - 30 or 1, 1))
    return log


def fold(log):
    active, seen, totals, applied, dead = 0, set(), {}, [], []
    for n, kind, e, i, o, s, d, _ in log:
        if kind == "fence":
            active = max(active, e)
        elif kind == "poison" or e != active:
            dead.append((n, "poison" if kind == "poison" else "stale"))
        elif i not in seen:
            seen.add(i)
            totals[o, s] = totals.get((o, s), 0) + d
            applied.append((n, i, totals[o, s]))
    return applied, dead


def test_replay_equals_model(spark):
    for seed in range(20):
        log = random_log(random.Random(seed))
        frame = spark.createDataFrame(log, f"sequence long, record_type string, epoch long, {OP}")
        applied, dead = fold(log)
        if seed < 4:
            got = replay.replay(frame).select("sequence", "operation_id", "balance").collect()
            assert sorted(map(tuple, got)) == sorted(applied)
        for most in (replay.MOST_FENCES, 3):  # intervals of fences, and stretches of the log
            spans = replay.active_epochs(frame, span=7 if seed % 2 else 1 << 16, most_fences=most).where("record_type = 'poison' or (record_type = 'operations' and epoch <> active)")
            assert sorted(r.sequence for r in spans.select("sequence").collect()) == sorted(n for n, _ in dead)


def test_validation(spark):
    cases = {" a": 1, "a ": 1, "　a": 1, "a​": 0, "a\tb": 1, "a\x85b": 1, "é" * 64: 0, "é" * 65: 1, "": 1, "a b": 0, None: 1}
    frame = spark.createDataFrame([(k, "o", "s", 1, 1, v) for k, v in cases.items()], OP + ", bad int")
    assert all((r.reason is not None) == bool(r.bad) for r in frame.select("*", reason().alias("reason")).collect())
    edge = spark.createDataFrame([("a", "o", "s", -(2**63), 1), ("a", "o", "s", None, 1), ("a", "o", "s", 10**9, 1)], OP)
    assert [r[0] for r in edge.select(reason()).collect()] == ["delta out of range", "missing delta", None]


def test_fingerprint(spark):
    import hashlib

    part = lambda b: len(b).to_bytes(8, "little") + b
    rows = [("x", "owner-é", "sku", -5, 1), ("y", "o", "s" * 128, 10**9, 1)]
    frame = spark.createDataFrame(rows, OP)
    want = [hashlib.sha256(part(o.encode()) + part(s.encode()) + part(d.to_bytes(8, "little", signed=True)) + part(v.to_bytes(8, "little"))).hexdigest() for _, o, s, d, v in rows]
    assert [r[0] for r in frame.select(fingerprint()).collect()] == want


def test_decode(spark):
    got = {r.sequence: r for r in catalog.q_decode_cascade(spark, SF).collect()}
    kinds = {n: (r.record_type, r.epoch, r.n_ops) for n, r in got.items()}
    good = {1: ("fence", 8, None), 2: ("operations", 8, 1), 3: ("operations", 0, 1), 7: ("operations", 0, 0), 9: ("operations", 8, 0), 13: ("operations", 0, 2)}
    assert kinds == {n: good.get(n, ("poison", None, None)) for n, _ in catalog.LINES}


def test_decode_by_form(spark):
    """Without the rules of values only the form makes a record poison."""
    got = files.decode(spark.createDataFrame(catalog.LINES, "sequence long, value string"), rules=False)
    deltas = {r.sequence: [o.delta for o in r.operations] for r in got.where("record_type = 'operations'").collect()}
    assert deltas == {2: [5], 3: [5], 5: [0], 7: [], 9: [], 13: [5, 6]}


def test_filters_do_not_repeat_the_parsing(spark):
    log = files.decode(catalog.log_lines(spark, SF))
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert plan(log.where(replay.FENCE)) < 2 * plan(log)


def test_requests_are_refused_whole(spark):
    ops = lambda *o: "[" + ",".join(o) + "]"
    one = '{"operation_id":"a","owner_id":"o","sku":"s","delta":%s%s}'
    lines = [
        (1, ops(one % ("1", ""), one % ("2.5", ""))), (2, "{broken"), (3, ""), (4, "[]"), (5, ops(one % ("1", ',"event_version":null'))), (6, ops(one % ("1", ""), one % ("0", ""))),
        (7, ops(one % ('"1"', ""))), (8, ops(one % ("1", ',"event_version":1,"note":"x"'))), (9, '{"a":1}'), (10, ops(*[one % (1, "")] * 10_001)), (11, ops('{"owner_id":"o","sku":"s","delta":1}')), (12, ops("3")),
    ]
    got = files.parse_batches(spark.createDataFrame(lines, "line long, value string"))
    why = {r.line: r.refused for r in got.select("line", "refused").distinct().collect()}
    bad, size = "invalid JSON batch", "batch must contain 1..=10000 operations"
    assert why == {1: bad, 2: bad, 3: bad, 4: size, 5: bad, 6: "zero delta", 7: bad, 8: None, 9: bad, 10: size, 11: bad, 12: bad}
    assert got.where("line = 8").select(*FIELDS).first() == ("a", "o", "s", 1, 1) and got.where("line = 10").count() == 10_001


def test_log_from_lines(spark):
    """Fences, a stale record, poison, order within a record, redelivery."""
    op = lambda i, d, s="s": {"operation_id": i, "owner_id": "o", "sku": s, "delta": d}
    record = lambda e, *ops: json.dumps({"record_type": "operations", "epoch": e, "operations": ops})
    lines = [
        (1, '{"record_type":"fence","epoch":8,"owner":"w"}'), (2, record(8, op("a", 73), op("b", -3), op("a", 73))), (3, record(7, op("c", 1000))), (4, "{invalid-json"),
        (5, '{"record_type":"fence","epoch":3,"owner":"late"}'), (6, record(8, op("a", 73))), (7, record(8)), (8, record(8, op("b", 5))), (9, record(8, op("d", 7))), (10, "[]"),
    ]
    log = files.decode(spark.createDataFrame(lines, "sequence long, value string"))
    assert [tuple(r) for r in replay.replay(log).select("sequence", "pos", "operation_id", "balance").orderBy("sequence", "pos").collect()] == [(2, 0, "a", 73), (2, 1, "b", 70), (9, 0, "d", 77)]
    dead = {r.source_sequence: (r.reason, bytes(r.payload).decode()) for r in replay.dead_letters(log, conflicts=True).collect()}
    assert dead == {n: (why, dict(lines)[n]) for n, why in ((3, "writer epoch 7 rejected; active epoch is 8"), (4, "poison"), (8, "conflict"), (10, "writer epoch 0 rejected; active epoch is 8"))}
    assert {r.operation_id: r.delta for r in replay.history(log).collect()} == {"a": 73, "b": 5, "d": 7}
    back = files.log_lines(log.where("sequence in (1, 2, 4)"))
    again = {r.sequence: r for r in files.decode(back).collect()}
    assert [(again[n].record_type, len(again[n].operations or [])) for n in (1, 2, 4)] == [("fence", 0), ("operations", 3), ("poison", 0)]


def test_batch_files(spark, tmp_path):
    ops = catalog.q_generate(spark, SF).limit(2500).withColumn("i", F.substring("operation_id", 5, 9).cast("long"))
    files.write_batches(ops, f"{tmp_path}/b", 1000)
    back = files.read_batches(spark, f"{tmp_path}/b")
    assert back.count() == 2500 and back.where("refused is not null").isEmpty() and back.agg(F.max("batch_size")).first()[0] <= 1000
    assert files.read_batches(spark, f"{tmp_path}/b", ("operation_id",)).columns == ["line", "batch_size", "pos", "operation_id", "refused"]
    files.write_samples(ops.select("operation_id", "delta"), f"{tmp_path}/csv")
    assert files.read_samples(spark, f"{tmp_path}/csv", "operation_id string, delta long").exceptAll(ops.select("operation_id", "delta")).isEmpty()
    checks = {r.path.rsplit("/", 1)[-1]: (r.bytes, r.crc32) for r in files.manifest(spark, f"{tmp_path}/b/*.txt").collect()}
    assert checks == {f.name: (f.stat().st_size, zlib.crc32(f.read_bytes())) for f in (tmp_path / "b").glob("*.txt")}
    assert files.manifest(spark, f"{tmp_path}/b/*.txt").where("length(sha256) = 64").count() >= 1


def test_pages(spark):
    rows = spark.createDataFrame([(f"id{i}", "o", "s", 1, 1) for i in range(20)], OP)
    first = reads.page(rows, F.col("owner_id") == "o", limit=10)
    cursor = reads.next_cursor(first, 10).first().next_cursor
    second = reads.page(rows, F.col("owner_id") == "o", cursor, 10)
    ids = [r.operation_id for r in first.collect() + second.collect()]
    assert ids == sorted(f"id{i}" for i in range(20))
    last = reads.next_cursor(reads.page(rows, F.col("owner_id") == "o", ids[-1], 10), 10).first()
    assert last.n == 0 and last.next_cursor is None
    with pytest.raises(ValueError):
        reads.page(rows, F.col("owner_id") == "o", limit=1001)


def test_history_behind(spark):
    rows = catalog.clean(spark, SF)
    reads.require_complete(rows, 900)
    for behind, checkpoint in ((rows, 10**9), (rows.limit(0), 0)):
        with pytest.raises(RuntimeError):
            reads.require_complete(behind, checkpoint)


def test_batch_reads_refuse_misses(spark):
    rows = catalog.clean(spark, SF)
    ids = lambda *i: spark.createDataFrame(list(enumerate(i)), "pos int, operation_id string")
    assert [r.operation_id for r in reads.operations_or_refusal(rows, ids("evt-9", "evt-3", "evt-9"), 10**9).collect()] == ["evt-9", "evt-3", "evt-9"]
    with pytest.raises(LookupError):
        reads.operations_or_refusal(rows, ids("evt-9", "none"), 10)
    with pytest.raises(RuntimeError):
        reads.operations_or_refusal(rows, ids("evt-9", "none"), 10**9)
    with pytest.raises(RuntimeError):
        reads.page(rows, checkpoint=10**9)
    for n in (0, 10_001):
        with pytest.raises(ValueError):
            reads.operations_batch(rows, ids(*["evt-1"] * n) if n else ids("x").limit(0))


def test_seen_twice_is_seen_once(spark):
    batch = spark.createDataFrame([(0, "a", "o", "s", 5, 1)], "pos int, " + OP)
    seen = batch.select(*FIELDS).union(batch.select(*FIELDS))
    state = spark.createDataFrame([("o", "s", 5)], "owner_id string, sku string, balance long")
    assert [(r.status, r.balance) for r in ledger.classify(batch, seen, state).collect()] == [("duplicate", 5)]


def test_percentiles_are_elements(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(9)) for k in "abc" for _ in range(rng.randint(1, 40))]
    rows += [(None, 4), ("one", 7), ("a", None)]
    got = observe.percentiles(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()
    assert {r.k for r in got} == {"a", "b", "c", None, "one"}
    rows.remove(("a", None))
    for r in got:
        own = sorted(v for k, v in rows if k == r.k)
        assert [r.p50, r.p95, r.p99] == [own[(len(own) - 1) * p // 100] for p in (50, 95, 99)]


def test_exposition(spark):
    rows = spark.createDataFrame([("a_total", 5), ("b", 7), ("pipeline_quorum_seconds_total", 2)], "metric string, value long")
    text = {r.value for r in observe.exposition(rows).collect()}
    assert "# TYPE warehouse_pipeline_quorum_seconds_total counter\nwarehouse_pipeline_quorum_seconds_total 2.000000000" in text
    assert {tuple(r) for r in observe.parse(observe.exposition(rows)).collect()} == {("a_total", 5.0), ("b", 7.0), ("pipeline_quorum_seconds_total", 2.0)}


def fleet(spark, seconds, **metrics):
    """Rows of two instances; a metric is a function from (instance, second)."""
    rows = [(f"n{k}", t * 1_000_000, *(float(f(k, t)) for f in metrics.values())) for k in range(2) for t in range(seconds)]
    return spark.createDataFrame(rows, "instance string, us long, " + ", ".join(f"{m} double" for m in metrics))


def test_alert_rules(spark):
    found = lambda **m: {(r.alert, r.instance, r.n) for r in observe.rule_alerts(fleet(spark, 60, **m), span=7_000_000).collect()}
    # one writer and a standby are healthy, also while the lease moves; two writers and none are not
    assert found(writer_lease_owned=lambda k, t: k == (t > 30)) == set()
    assert found(writer_lease_owned=lambda k, t: k == 0 or t > 50) == {("MultipleWriters", None, 9)}
    assert found(writer_lease_owned=lambda k, t: k == 0 and t > 20) == {("NoWriter", None, 21)}
    # a node by itself, the lag of the worst node, the ratio of each node
    assert found(up=lambda k, t: k or t > 40) == {("NodeDown", "n0", 41)}
    assert found(replication_lag=lambda k, t: 9 * (k == t % 2)) == {("ReplicationLag", None, 60)}
    assert found(stream_bytes=lambda k, t: 96 if k else 0, stream_max_bytes=lambda k, t: 100) == {("LogCritical", None, 60)}
    assert found(quorum_available=lambda k, t: k and t != 30) == set()
    assert found(history_lag=lambda k, t: 1) == set() and found(other=lambda k, t: 1) == set()


@pytest.mark.parametrize("span", [1, 3, 10, 10**9])
def test_series_in_stretches(spark, span):
    """Runs, rates and increases do not depend on how time is cut."""
    rng = random.Random(span)
    rows = [(k, us, n, rng.random() < 0.7, rng.randrange(5)) for k in "ab" for n, us in enumerate(sorted(rng.choices(range(60), k=45)))]
    frame = spark.createDataFrame(rows, "k string, us long, n int, good boolean, v long")
    want = set()
    for key in "ab":
        for good, own in itertools.groupby((r for r in rows if r[0] == key), key=lambda r: r[3]):
            own = list(own)
            if good:
                want.add((key, own[0][1], own[-1][1], len(own)))
    assert {tuple(r) for r in observe.runs(frame, ["k"], "us", "n", F.col("good"), span).select("k", "start_us", "end_us", "n").collect()} == want
    grown = {}
    for key in "ab":
        own = [r for r in rows if r[0] == key]
        for before, r in zip([None, *own], own):
            grown[key, r[2]] = 0 if before is None else r[4] if r[4] < before[4] else r[4] - before[4]
    got = observe.increases(frame, "v", "k", "us", "n", span).collect()
    assert {(r.k, r.n): r.increase for r in got} == grown and len(got) == len(rows)
    scaled = frame.withColumn("us", F.col("us") * 1_000_000)
    rates = observe.rates(scaled, "v", "k", "us", "n", 5, max(span, 6) * 1_000_000).collect()
    assert len(rates) == len(rows)
    for r in rates:
        assert r.rate == pytest.approx(sum(g for (k, n), g in grown.items() if k == r.k and 0 <= r.us / 1e6 - next(x[1] for x in rows if x[0] == k and x[2] == n) <= 5) / 5)


def test_running_sums_in_stretches(spark):
    rng = random.Random(4)
    rows = [(k, n, rng.randrange(-9, 9)) for n, k in enumerate(rng.choices([None, "a", "b"], [1, 8, 1], k=200))]
    frame = spark.createDataFrame(rows, "k string, n long, v long")
    want, sums = set(), {}
    for k, n, v in rows:
        sums[k] = sums.get(k, 0) + v
        want.add((n, sums[k]))
    for span in (1, 7, 1000):
        got = ledger.running_sum(frame, ["k"], F.col("v"), "s", F.floor(F.col("n") / span), "n")
        assert {(r.n, r.s) for r in got.collect()} == want and got.columns == ["k", "n", "v", "s"]


BATCHES = [
    [("n", "o1", "s1", 5, 1)], [("m", "o1", "s1", 5, 1), ("m", "o1", "s1", 5, 1)], [("n", "o1", "s1", 9, 1), ("z", "o1", "s1", 1, 1)],
    [("q", "o1", "s1", 1, 1), ("q", "o1", "s1", 2, 1)], [("n", "o1", "s1", 5, 1), ("p", "o2", "s1", -3, 1)], [("bad", "o", "s", 0, 1)],
]


def put(spark, source, rows, schema, kind="parquet"):
    getattr(spark.createDataFrame(rows, schema).coalesce(1).write.mode("append"), kind)(source)


@pytest.mark.parametrize("files_", [1, 64])
def test_requests_stream(spark, tmp_path, files_):
    """Batches one at a time and together; a crash before the commit; a second delivery."""
    source, store, check = f"{tmp_path}/in", Store(spark, f"{tmp_path}/store"), f"{tmp_path}/check"
    schema = "batch long, pos int, " + OP
    rows = lambda k: [(k, p, *r) for p, r in enumerate(BATCHES[k])]
    for k in range(4):
        put(spark, source, rows(k), schema)

    def crash(step):
        if step == "commit":
            raise RuntimeError("crash")

    with pytest.raises(Exception):
        streaming.ingest(spark, source, store, check, files_, crash).awaitTermination()
    assert store.read("results").isEmpty() and store.progress() == (-1, 0)  # nothing of it can be seen
    streaming.ingest(spark, source, store, check, files_).awaitTermination()
    for k in (4, 5, 1):  # the last one is request 1 once more
        put(spark, source, [(10 + k, *r[1:]) for r in rows(k)], schema)
        streaming.ingest(spark, source, store, check, files_).awaitTermination()
    got = sorted((r.batch, r.pos, r.status, r.balance) for r in store.read("results").collect())
    assert got == [(0, 0, "applied", 5), (1, 0, "applied", 10), (1, 1, "duplicate", 5), (11, 0, "duplicate", 10), (11, 1, "duplicate", 10), (14, 0, "duplicate", 10), (14, 1, "applied", -3)]
    assert {tuple(r) for r in store.read("balances").collect()} == {("o1", "s1", 10), ("o2", "s1", -3)}
    assert {tuple(r) for r in store.read("rejected").collect()} == {(2, "n", "conflict"), (3, "q", "conflict"), (15, "bad", "zero delta")}


def test_requests_settle_in_order(spark, tmp_path):
    """A request that is refused leaves nothing that later ones could clash with."""
    rows = [(0, "a", 1), (1, "a", 2), (1, "b", 2), (2, "b", 3), (3, "b", 2), (3, "c", 1), (4, "c", 1), (5, "d", 1), (5, "d", 2)]
    frame = spark.createDataFrame([(n, k, i, "o", "s", d, 1) for k, (n, i, d) in enumerate(rows)], "batch long, pos int, " + OP)
    store = Store(spark, f"{tmp_path}/store")
    streaming.apply_requests(store, frame, 0)
    assert {(r.batch, r.operation_id) for r in store.read("rejected").collect()} == {(1, "a"), (3, "b"), (5, "d")}
    assert {(r.operation_id, r.delta, r.status) for r in store.read("results").collect()} == {("a", 1, "applied"), ("b", 3, "applied"), ("c", 1, "applied")}
    with pytest.raises(RuntimeError):
        streaming.apply_requests(store, frame, 1, most_contested=1)


def test_log_stream(spark, tmp_path):
    """Live and history tails over the fenced log, delivered twice and restarted,
    end in what a replay gives; so does a store that is built anew."""
    lines = catalog.log_lines(spark, SF).withColumnRenamed("value", "record")
    live, past = Store(spark, f"{tmp_path}/live"), Store(spark, f"{tmp_path}/past")
    source = f"{tmp_path}/log"
    for low, high in ((0, 300), (300, 520), (250, 700), (700, 2000)):
        lines.where((F.col("sequence") >= low) & (F.col("sequence") < high)).coalesce(1).write.mode("append").json(source)
        streaming.tail(spark, source, live, f"{tmp_path}/c1", files=1).awaitTermination()
        streaming.tail(spark, source, past, f"{tmp_path}/c2", streaming.apply_history, files=1).awaitTermination()
    log = catalog.fenced_log(spark, SF)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    position = ("owner_id", "sku", "balance")
    want = rows(catalog.q_replay_balances(spark, SF), *position)
    assert rows(live.read("balances"), *position) == want
    dead = ("source_stream", "source_sequence", "reason", "payload")
    assert rows(live.dead_letters(), *dead) == rows(replay.dead_letters(log), *dead)
    assert rows(streaming.history(past), *FIELDS) == rows(replay.history(log), *FIELDS)
    last = log.agg(F.max("sequence")).first()[0]
    epoch = replay.active_epochs(log).agg(F.max("active")).first()[0]
    assert live.progress() == past.progress() == (last, epoch)
    # a micro-batch that runs again after its commit, and a compaction
    versions = live.versions()
    again = lines.where((F.col("sequence") >= 700) & (F.col("sequence") < 2000))
    streaming.apply_log(live, again, versions[-1])
    live.compact("seen", versions[-2], "operation_id")
    live.compact("seen", versions[-2], "operation_id")
    assert rows(live.read("balances"), *position) == want and live.seen().count() == replay.history(log).count()
    # damage: set aside and built anew from the log
    moved = live.set_aside()
    assert moved.startswith(f"{tmp_path}/live.corrupt-") and live.versions() == []
    streaming.rebuild(live, files.decode(lines, "record"))
    assert rows(live.read("balances"), *position) == want and live.progress() == (last, epoch)
    assert rows(live.dead_letters(), *dead) == rows(replay.dead_letters(log), *dead)


def test_append_is_idempotent(spark):
    ops = spark.createDataFrame([(b, p, f"op{b}-{p}", "o", "s", 1, 1) for b in range(5) for p in range(3)], "batch long, pos long, " + OP)
    start = log_ops.fence(spark.createDataFrame([], "sequence long"), 3, "w")
    assert start.first()[:2] == (1, '{"record_type":"fence","epoch":3,"owner":"w"}')
    once = log_ops.appended(start, log_ops.messages(ops.where("batch < 3"), 3))
    both = start.unionByName(once)
    more = log_ops.appended(both, log_ops.messages(ops, 3))
    assert sorted(r.sequence for r in once.collect()) == [2, 3, 4] and sorted(r.sequence for r in more.collect()) == [5, 6]
    assert log_ops.appended(both, log_ops.messages(ops.limit(0), 3)).isEmpty()
    got = replay.replay(files.decode(both.unionByName(more)))
    assert [r.operation_id for r in got.orderBy("sequence", "pos").collect()] == [f"op{b}-{p}" for b in range(5) for p in range(3)]


def test_binary_imports(spark, tmp_path):
    ops = [("op1", "owner-é", "s", -5, 1), ("op2", "o", "s" * 300, 10**9, 1)]
    whole = binary.wal_bytes(ops)
    legacy = b'{"operation_id":"j","owner_id":"o","sku":"s","delta":4}'
    (tmp_path / "wal").mkdir()
    cases = {"good": whole, "torn": whole + binary.wal_bytes(ops)[:-3], "json": len(legacy).to_bytes(4, "little") + zlib.crc32(legacy).to_bytes(4, "little") + legacy, "empty": b"", "damaged": whole[:-1] + b"!"}
    for name, data in cases.items():
        (tmp_path / "wal" / name).write_bytes(data)
    got = {}
    for r in binary.read_wal(spark, f"{tmp_path}/wal").orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append(tuple(r)[2:7] if r.error is None else r.error)
    assert got == {"good": ops, "torn": [*ops, ops[0]], "json": [("j", "o", "s", 4, 1)], "damaged": ["wrong checksum"]}
    data = binary.snapshot_bytes(42, 8, [("o", "s", 77), ("p", "é", -1)])
    assert binary.snapshot(data) == (42, 8, [("o", "s", 77), ("p", "é", -1)])
    for bad in (data[:-1], data[:-1] + b"x", data[:20], b"x" * 60):
        with pytest.raises(binary.Corrupt):
            binary.snapshot(bad)
    (tmp_path / "snap").write_bytes(data)
    assert [tuple(r)[1:6] for r in binary.read_snapshot(spark, f"{tmp_path}/snap").collect()] == [(42, 8, "o", "s", 77), (42, 8, "p", "é", -1)]
    assert binary.checkpoint(b"WCP1" + (9).to_bytes(8, "little") + (3).to_bytes(8, "little")) == (9, 3)
    assert binary.checkpoint(b'{"sequence":5,"writer_epoch":2}') == (5, 2) and binary.checkpoint(b"17") == (17, 0)
    for bad in (b"WCP1x", b"{", b""):
        with pytest.raises(binary.Corrupt):
            binary.checkpoint(bad)
    fence = binary.LOG_MARK + b"\x01" + (8).to_bytes(8, "little") + binary.long_text("w")
    batch = binary.LOG_MARK + b"\x02" + (7).to_bytes(8, "little") + (2).to_bytes(4, "little") + b"".join(map(binary.operation_bytes, ops))
    assert binary.log_record(fence) == ("fence", 8, "w", None) and binary.log_record(batch) == ("operations", 7, None, ops)
    for bad in (fence[:-1], batch + b"x", b"junk"):
        with pytest.raises(binary.Corrupt):
            binary.log_record(bad)


def test_log_conflicts(spark):
    rows = [(0, "fence", 1, None, None, None, None, None), (1, "operations", 1, "a", "o", "s", 1, 1), (2, "operations", 1, "a", "o", "s", 2, 1), (3, "operations", 1, "a", "o", "s", 1, 1)]
    log = spark.createDataFrame(rows, f"sequence long, record_type string, epoch long, {OP}")
    assert [(r.sequence, r.operation_id) for r in replay.conflicting_rows(log).collect()] == [(2, "a")]
    assert ledger.balances(replay.replay(log).drop("balance")).first().balance == 1


def test_every_batch_is_classified(spark):
    rows = catalog.requests(spark, SF).collect()
    assert {r.operation_id for r in rows} == {f"evt-{r.event_id}" for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    seen, balances, want = set(), {}, []
    for batch in sorted({r.batch for r in rows}):
        before = dict(balances)
        for r in sorted((r for r in rows if r.batch == batch), key=lambda r: r.pos):
            new, at = r.operation_id not in seen, (r.owner_id, r.sku)
            seen.add(r.operation_id)
            if new:
                balances[at] = balances.get(at, 0) + r.delta
            want.append((batch, r.pos, r.operation_id, "applied" if new else "duplicate", (balances if new else before).get(at, 0)))
    got = catalog.QUERIES["q_batch_classify"](spark, SF)
    assert sorted(map(tuple, got.select("batch", "pos", "operation_id", "status", "balance").collect())) == sorted(want)


def test_every_batch_is_searched_for_conflicts(spark):
    rows = [(0, "a", 1), (0, "a", 1), (0, "b", 1), (0, "b", 2), (1, "a", 1), (2, "a", 2), (3, "a", 1), (3, "c", 5), (4, "d", 1)]
    ops = spark.createDataFrame([(n, i, "o", "s", d, 1) for n, i, d in rows], "batch long, " + OP)
    assert sorted(map(tuple, ledger.batch_conflicts_of_all(ops).collect())) == [(0, "b"), (2, "a"), (3, "a")]
