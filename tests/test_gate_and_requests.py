"""The gate before recognition and idempotent requests: plain versions, streams against batch, timers and expiry."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnwise.operators import gate, idempotency, intervals
from turnwise.streaming import joins, late, processors, run

CAPTURES = "room int, client_id long, utterance_id long, received_ms long, started_ms long, ended_ms long, avg_rms double, peak_rms double"


def captures(seed, n=250, rooms=2):
    rng, rows, at = random.Random(seed), [], 1_000_000
    for i in range(n):
        at += rng.choice([0, 1, 40, 200, 499, 500, 501, 700, 4000])
        start = at - 1000 - rng.choice([0, 50, 400])
        rows.append((i % rooms, rng.randrange(5), i, at, start, at - rng.choice([0, 60, 300]), rng.choice([0.0, 0.1, 0.3]), rng.choice([0.1, 0.4])))
    return rows


def plain_gate(rows, hold=500, capacity=128):
    """Each room, millisecond by millisecond: what has come, then what is due."""
    out = []
    for room in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == room), key=lambda r: (r[3], r[2]))
        waiting = []
        times = sorted({r[3] for r in own} | {r[3] + hold for r in own})
        for now in times:
            # At its last moment a hold still takes in what comes: arrivals first, but groups of earlier moments have left.
            for r in (r for r in own if r[3] == now):
                if len(waiting) >= capacity:
                    out.append((room, r[2], r[2], True, False, True, now))
                else:
                    waiting.append(r)
            while waiting and waiting[0][3] + hold <= now:
                seed = waiting[0]

                def near(a, b):
                    both = max(0, min(a[5], b[5]) - max(a[4], b[4]))
                    return a[1] != b[1] and abs(a[4] - b[4]) <= 650 and abs(a[5] - b[5]) <= 900 and both / min(max(1, a[5] - a[4]), max(1, b[5] - b[4])) >= 0.7

                group = [x for x in waiting if x is seed or near(seed, x)]
                waiting = [x for x in waiting if x not in group]
                loud = sorted(group, key=lambda x: (-x[6], -x[7], x[3], x[2]))[0]
                for x in group:
                    hears = x is not loud and near(loud, x) and loud[6] > 0 and x[6] > 0 and loud[6] / x[6] >= 1.6 and loud[7] / x[7] >= 1.25
                    out.append((room, seed[2], x[2], x is loud, hears, False, seed[3] + hold))
    return sorted(out)


@pytest.mark.parametrize(("seed", "capacity"), [(1, 128), (2, 128), (3, 2), (4, 1)])
def test_gate_equals_a_plain_clock(spark, seed, capacity):
    rows = captures(seed)
    df = spark.createDataFrame(rows, CAPTURES).repartition(3)
    got = sorted(map(tuple, gate.gated(df, gate.Limits(capacity=capacity)).collect()))
    assert got == plain_gate(rows, capacity=capacity)
    assert len(got) == len(rows) and any(x[5] for x in got) == (capacity < 128)
    assert any(x[4] for x in got) or capacity < 128


def stream_of(spark, tmp_path, rows, schema, at, files, seed=0, jitter=3000):
    """Rows as a stream of files, in nearly the order of their times: none is later than ``jitter``."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[at] + rng.randint(0, jitter))
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{tmp_path}/in{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")


def states(query):
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress if p.stateOperators]


def through(out, tmp_path, name):
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return out.sparkSession.table(name).collect(), query


@pytest.mark.parametrize("capacity", [128, 2])
def test_gate_stream_equals_batch(spark, tmp_path, capacity):
    rows = captures(5, n=160)
    limits = gate.Limits(capacity=capacity)
    want = sorted(map(tuple, gate.gated(spark.createDataFrame(rows, CAPTURES), limits).collect()))
    # A capture long after the others lets the watermark pass them; it waits itself.
    last = (0, 0, 10_000, rows[-1][3] + 60_000, rows[-1][3] + 59_000, rows[-1][3] + 60_000, 0.1, 0.1)
    stream = stream_of(spark, tmp_path, [*rows, last], CAPTURES, 3, 5).withColumn("received_at", F.timestamp_millis("received_ms")).withWatermark("received_at", "5 seconds")
    got, query = through(processors.gate_stream(stream, limits), tmp_path, f"gate_{capacity}")
    assert sorted(map(tuple, got)) == want
    assert states(query)[-1] < max(states(query))


class Held:
    """States and timers of one key, as a processor sees them."""

    def __init__(self):
        self.rows, self.value, self.timers = {}, {}, set()

    def getMapState(self, name, *_):
        rows = self.rows
        return type("Map", (), {"keys": lambda _: iter(list(rows)), "getValue": lambda _, k: rows[k], "updateValue": lambda _, k, v: rows.update({k: v}), "removeKey": lambda _, k: rows.pop(k)})()

    def getValueState(self, name, _):
        value = self.value
        return type("Value", (), {"exists": lambda _: name in value, "get": lambda _: value[name], "update": lambda _, v: value.update({name: v}), "clear": lambda _: value.pop(name, None)})()

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("capacity", [128, 2])
def test_waiting_rows_are_taken_up_slot_by_slot(spark, monkeypatch, capacity):
    """Rows of many slots, in batches of any order and watermarks amid a slot: the groups of a plain clock, and never more than a slot's rows at once."""
    monkeypatch.setattr(processors, "SLOT_MS", 5000)
    monkeypatch.setattr(processors, "TOGETHER", 7)
    loaded, loads = [], processors.pickle.loads
    rows = captures(9, n=200, rooms=1)
    gate_ = processors.Gate(spark.createDataFrame(rows[:1], CAPTURES), gate.Limits(capacity=capacity))
    held, out = Held(), []
    gate_.init(held)
    monkeypatch.setattr(processors.pickle, "loads", lambda x: loaded.append(len(y := loads(x))) or y)
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    for i in range(0, 200, 50):
        part = rows[i : i + 50]
        mark = part[-1][3]
        random.Random(i).shuffle(part)
        gate_.handleInputRows((0,), iter([pd.DataFrame(part[k : k + 5], columns=names) for k in range(0, 50, 5)]), None)
        # Rows of the mark's own time wait for it to pass.
        for now in (mark - 3000, mark):
            while held.timers and min(held.timers) <= now:
                held.timers.discard(min(held.timers))
                clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda _, now=now: now})()
                for df in gate_.handleExpiredTimer((0,), clock, None):
                    assert len(df)
                    out += df.itertuples(index=False, name=None)
    end = rows[-1][3] + 60_000
    for df in gate_.handleExpiredTimer((0,), type("Clock", (), {"getCurrentWatermarkInMs": lambda _: end})(), None):
        out += df.itertuples(index=False, name=None)
    assert sorted(out) == plain_gate(rows, capacity=capacity)
    assert not held.rows and not held.value and max(loaded) <= 50


EVENTS = "key string, at_ms long, seq long, kind string, request_id string, fingerprint string, ok boolean"


def requests(seed, n=400, keys=4):
    rng, rows, at, live = random.Random(seed), [], 1_000_000, {}
    for i in range(n):
        at += rng.choice([0, 5, 300, 2000, 20_000])
        key = f"k{rng.randrange(keys)}"
        if rng.random() < 0.55 or not live.get(key):
            live.setdefault(key, []).append(f"r{i}")
            rows.append((key, at, i, "begin", f"r{i}", rng.choice(["f", "f", "f", "g"]), None))
        else:
            who = rng.choice(live[key])
            kind = rng.choice(["finish", "finish", "abort"])
            rows.append((key, at, i, kind, who, None, rng.random() < 0.7 if kind == "finish" else None))
    return rows


def plain_requests(rows, ttl, lease):
    """Per key a list of what is open, by the rules as told in words."""
    out = []
    for key in sorted({r[0] for r in rows}):
        entry = None  # {"f", "lead", "since", "wait"} or {"f", "by", "until"}

        def give_up(at):
            nonlocal entry
            out.append((key, entry["lead"], "aborted", None, None, at))
            entry = {"f": entry["f"], "lead": entry["wait"][0], "since": at, "wait": entry["wait"][1:]} if entry["wait"] else None

        for _, at, _, kind, who, f, ok in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            while entry and "lead" in entry and entry["since"] + lease <= at:
                give_up(entry["since"] + lease)
            if entry and "by" in entry and entry["until"] <= at:
                entry = None
            leads = entry is not None and entry.get("lead") == who
            if kind == "begin" and entry is None:
                entry = {"f": f, "lead": who, "since": at, "wait": []}
            elif kind == "begin" and entry["f"] != f:
                out.append((key, who, "conflict", None, None, at))
            elif kind == "begin" and "by" in entry:
                out.append((key, who, "cached", entry["by"], True, at))
            elif kind == "begin":
                entry["wait"].append(who)
            elif kind == "abort" and leads:
                give_up(at)
            elif kind == "finish" and leads:
                out.append((key, who, "created", who, ok, at))
                out += [(key, w, "coalesced", who, ok, at) for w in entry["wait"]]
                entry = {"f": entry["f"], "by": who, "until": at + ttl} if ok else None
    return sorted(map(str, out))


@pytest.mark.parametrize(("seed", "lease"), [(1, 10**9), (2, 10**9), (3, 15_000)])
def test_requests_equal_a_plain_version(spark, seed, lease):
    rows = requests(seed)
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    got = sorted(str(tuple(r)) for r in idempotency.resolved(df, 60_000, lease).collect())
    assert got == plain_requests(rows, 60_000, lease)
    for status in ("created", "coalesced", "cached", "conflict", "aborted"):
        assert any(status in g for g in got)


def test_requests_stream_equals_batch_and_state_expires(spark, tmp_path):
    rows = requests(4, n=200)
    end = rows[-1][1]
    want = plain_requests([*rows, *((f"k{i}", end + 10**6, 10**6, "begin", "late", "f", None) for i in range(4))], 60_000, 15_000)
    last = ("other", end + 10**6 + 60_000, 10**6, "begin", "last", "f", None)
    closing = [(f"k{i}", end + 10**6, 10**6, "begin", "late", "f", None) for i in range(4)]
    stream = stream_of(spark, tmp_path, [*rows, *closing, last], EVENTS, 1, 4).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "5 seconds")
    got, query = through(processors.resolved_stream(stream, 60_000, 15_000), tmp_path, "requests")
    got = sorted(str(tuple(r)) for r in got if r.request_id != "late")
    assert got == [w for w in want if "'late'" not in w]
    # All answers and leases but those of the very last requests are over, and so is their state.
    assert states(query)[-1] <= 1 + 1 < max(states(query))


def test_late_rows_are_rejects_and_none_is_lost(spark, tmp_path):
    rng, rows = random.Random(6), []
    for batch in range(5):
        for i in range(60):
            rows.append((batch, batch * 60 + i, 1_000_000 + batch * 10_000 + rng.randint(-25_000, 10_000)))
    schema = "batch int, id long, at_ms long"
    for b in range(5):
        spark.createDataFrame([r for r in rows if r[0] == b], schema).coalesce(1).write.parquet(f"{tmp_path}/in{b}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in*")
    for _ in range(2):  # the second run finds nothing new and changes nothing
        query = late.split(stream, F.col("at_ms"), 8_000, f"{tmp_path}/split", availableNow=True)
        query.awaitTermination(240)
        assert query.exception() is None
    accepted, rejects = (spark.read.parquet(f"{tmp_path}/split/{x}") for x in ("accepted", "rejects"))
    marks = late.marked(spark.createDataFrame(rows, schema), "batch", F.col("at_ms"), 8_000)
    assert {r.id for r in rejects.collect()} == {r.id for r in marks.where("is_late").collect()} != set()
    assert sorted(r.id for r in accepted.select("id").union(rejects.select("id")).collect()) == list(range(300))
    assert {r.reason for r in rejects.collect()} == {late.LATE}
    newest, plain = None, set()
    for b in range(5):
        own = [r for r in rows if r[0] == b]
        plain |= {r[1] for r in own if newest is not None and r[2] < newest - 8_000}
        newest = max([newest or 0, *(r[2] for r in own)])
    assert {r.id for r in rejects.collect()} == plain
    # What is accepted passes a watermark of the same delay without loss.
    timed = spark.readStream.schema("batch int, id long, at_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/split/accepted").withColumn("at", F.timestamp_millis("at_ms"))
    out = timed.withWatermark("at", "8 seconds").groupBy(F.window("at", "10 seconds")).count()
    memory = out.writeStream.format("memory").queryName("kept").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    memory.awaitTermination(240)
    assert spark.table("kept").agg(F.sum("count")).first()[0] == accepted.count()


def test_echo_stream_equals_batch(spark, tmp_path):
    rows = captures(7, n=200, rooms=2)
    schema = CAPTURES
    last = (0, 9, 10_000, rows[-1][3] + 600_000, rows[-1][3] + 600_000, rows[-1][3] + 601_000, 0.1, 0.1)
    stream = stream_of(spark, tmp_path, [*rows, last], schema, 4, 4).withColumn("started_at", F.timestamp_millis("started_ms"))
    got, query = through(joins.echo_stream(stream), tmp_path, "echoes")
    want = intervals.echoes(intervals.same_window(spark.createDataFrame(rows, schema))).collect()
    pairs = lambda found: sorted((r.room, r.left_id, r.right_id) for r in found)
    assert pairs(got) == pairs(want) != []
    assert states(query)[-1] < max(states(query))
    plain = spark.readStream.schema(schema).parquet(f"{tmp_path}/in*").withColumn("started_at", F.timestamp_millis("started_ms"))
    assert pairs(run.finished(joins.echo_stream(plain), f"{tmp_path}/run").collect()) == pairs(want)


