"""Voice activity, identity, idempotency, intervals, audio; batch against stream; order of input."""

import math
import pickle
import random
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import audio, hashing
from turnwise.operators import identity, idempotency, intervals, metrics, sessions, turns, vad
from turnwise.streaming import stateful

LOUD, QUIET = (0.1, 0.2), (0.0005, 0.001)


def run(levels):
    state, out, now = vad.State(), [], 0
    for rms, peak in levels:
        now += 20
        out += vad.step(state, now, rms, peak)
    return state, out, now


def test_onset_and_silence():
    state, out, _ = run([QUIET] * 10 + [LOUD] * 3 + [QUIET])
    assert not state.active and not out
    _, out, _ = run([QUIET] * 10 + [LOUD] * 30 + [QUIET] * 35)
    (segment,) = out
    assert segment[-1] == "silence" and segment[2] == 0 and segment[4] == (10 + 30 + 35) * 20


def test_hard_cut_carries_overlap_and_turns_go_on():
    state, out, now = run([LOUD] * 650)
    assert out[0][-1] == "hard-cut" and out[0][4] == 12_000
    out += vad.finish(state, now)
    assert out[1][0] == out[0][0] and out[1][1] == 1 and out[1][5] == 800
    assert out[0][4] + out[1][4] == 650 * 20


@pytest.mark.parametrize(("gap", "turn"), [(1500, 1), (1501, 2)])
def test_turn_gap(gap, turn):
    state = vad.State(last_end=1000, turn=1)
    out = []
    for i in range(4):
        out += vad.step(state, 1000 + gap, *LOUD)
    assert state.active and state.turn == turn


def test_noise_learning():
    state = vad.State()
    vad.learn_noise(state, 2000, 0.016, "empty")
    assert state.pending_noise == pytest.approx(0.0056)
    vad.learn_noise(state, 1000, 0.9, "empty")
    vad.learn_noise(state, 2000, 0.9, "other")
    assert state.pending_noise == pytest.approx(0.0056)
    list(vad.step(state, 20, *LOUD))
    assert state.noise == pytest.approx(0.0056)


def frames(seed=1, clients=3, n=2000):
    rng = random.Random(seed)
    rows = []
    for c in range(clients):
        loud = False
        for i in range(n):
            loud = loud if rng.random() < 0.98 else not loud
            rms, peak = LOUD if loud else QUIET
            rows.append((c, (i + 1) * 20, i, rms * rng.uniform(0.5, 1), peak, i == n - 1))
    return rows


SCHEMA = "client_id long, ts_ms long, frame_no long, rms double, peak double, end boolean"


def stream(spark, tmp_path, rows, schema, parts, build, name):
    """Rows through a stream in so many files, and what comes out."""
    path = str(tmp_path / "in")
    size = math.ceil(len(rows) / parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted(map(str, spark.sql(f"select * from {name}").collect()))


def test_vad_batch_equals_stream_and_any_order(spark, tmp_path):
    rows = sorted(frames(), key=lambda r: (r[1], r[0]))
    batch = sorted(map(str, vad.segments(spark.createDataFrame(rows, SCHEMA)).collect()))
    shuffled = random.Random(5).sample(rows, len(rows))
    assert sorted(map(str, vad.segments(spark.createDataFrame(shuffled, SCHEMA)).collect())) == batch
    assert stream(spark, tmp_path, rows, SCHEMA, 3, stateful.vad_stream, "vad_out") == batch


def test_identity_rules():
    room = identity.Room()
    a, b = np.array([1, 0, 0], np.float32), np.array([0, 1, 0], np.float32)
    assert identity.assign(room, a)[:2] == ("SPEAKER_00", "new")
    near = np.array([0.65, math.sqrt(1 - 0.65**2), 0], np.float32)
    assert identity.assign(room, near)[:2] == ("SPEAKER_00", "match-strong")
    one = identity.Room()
    identity.assign(one, a)
    half = np.array([0.5, 0, math.sqrt(0.75)], np.float32)
    assert identity.assign(one, half, single_soft=True)[1] == "match-soft"
    two = identity.Room()
    identity.assign(two, a)
    assert identity.assign(two, b)[:2] == ("SPEAKER_01", "new")
    clear = np.array([0.45, 0.1, math.sqrt(1 - 0.45**2 - 0.01)], np.float32)
    assert identity.assign(two, clear)[1] == "match-clear-soft"
    for _ in range(20):
        identity.assign(two, a)
    assert len(two.speakers[0].gallery) == 8


def test_speakers_found_by_one_product_are_those_of_all_products(monkeypatch):
    """Decisions equal those of a room that scores every speaker, with equal voices, empty ones, other lengths and no numbers; few speakers are scored one by one."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((90, 12))
    voices = [(c := centres[rng.integers(90)] + rng.standard_normal(12) * 0.25) / np.linalg.norm(c) for _ in range(700)]
    odd = [voices[3], voices[3], [], [1.0], [-1.0], [], [0.0] * 12, [1e30] * 12, voices[5], [0.5, 0.5], [0.5, 0.5]]

    class Plain(identity.Room):
        def scores(self, x):
            self.rows = self.rows or {}
            return {i: max([identity._dot(x, s.centroid), *(identity._dot(x, g) for g in s.gallery)]) for i, s in enumerate(self.speakers)}

    for tail in (odd, [*odd, [float("nan")] * 12, voices[7], voices[8]]):
        for soft in (False, True):
            a, b = identity.Room(), Plain()
            got = []
            for i, v in enumerate([*voices[:300], *tail]):
                a = pickle.loads(pickle.dumps(a)) if i % 50 == 0 else a
                got.append(identity.assign(a, v, 0.8, soft))
            assert str(got) == str([identity.assign(b, v, 0.8, soft) for v in [*voices[:300], *tail]])
            assert max(len(s.gallery) for s in a.speakers) > 3
    calls, dot = [], identity._dot
    monkeypatch.setattr(identity, "_dot", lambda x, y: calls.append(1) or dot(x, y))
    room = identity.Room()
    for v in voices:
        identity.assign(room, v, 0.8)
    assert len(room.speakers) > 60 and len(calls) < 40 * len(voices)


def test_identity_batch_equals_stream(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 8))
    rows = []
    for i in range(120):
        v = centres[i % 4] + rng.standard_normal(8) * 0.4
        rows.append((f"room{i % 2}", i, [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    schema = "room string, id long, v array<float>"
    batch = sorted(map(str, identity.assigned(spark.createDataFrame(rows, schema), "room", ["id"]).collect()))
    assert stream(spark, tmp_path, rows, schema, 3, stateful.identity_stream, "id_out") == batch


def test_turn_log_batch_equals_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for t in range(6):
        words = [f"w{i}" for i in range(60)]
        for s in range(5):
            rows.append(("r", f"c{t}", f"t{t}", s, s * 1000, s * 1000 + 900, 900, " ".join(words[max(0, s * 8 - 5) : s * 8 + rng.randint(4, 9)])))
    schema = "room string, client_id string, turn_id string, segment_index int, started_ms long, ended_ms long, audio_ms long, text string"
    rows.sort(key=lambda r: r[3])
    batch = sorted(map(str, turns.turn_log(spark.createDataFrame(rows, schema)).collect()))
    assert stream(spark, tmp_path, rows, schema, 5, stateful.turn_stream, "turn_out") == batch


def test_idempotency_batch_equals_stream(spark, tmp_path):
    ttl = 1000
    rows = [("k", "a", 0, 1, True), ("k", "a", 10, 2, True), ("k", "b", 20, 3, True), ("k", "b", 2000, 4, True), ("f", "a", 0, 5, False), ("f", "a", 5, 6, True), ("f", "a", 6, 7, True)]
    schema = "key string, fingerprint string, at_ms long, seq long, ok boolean"
    got = idempotency.statuses(spark.createDataFrame(rows, schema), ttl)
    assert {r.seq: r.idempotency_status for r in got.collect()} == {1: "created", 2: "cached", 3: "conflict", 4: "created", 5: "created", 6: "created", 7: "cached"}
    batch = sorted(map(str, got.select("key", "seq", "idempotency_status").collect()))
    assert stream(spark, tmp_path, rows, schema, 3, lambda s: stateful.idempotent_stream(s, ttl), "idem_out") == batch


def test_final_turns_by_watermark(spark, tmp_path):
    schema = "client_id string, turn_id string, ts timestamp"
    rows = [("c", "t1", datetime(2026, 1, 1, 0, 0, s)) for s in (0, 1)] + [("c", "t2", datetime(2026, 1, 1, 0, 1, 0)), ("c", "t3", datetime(2026, 1, 1, 0, 2, 0))]
    got = stream(spark, tmp_path, rows, schema, 2, lambda s: stateful.final_turns(s.withWatermark("ts", "1 second")), "final_out")
    assert any("t1" in r and "segments=2" in r for r in got) and not any("t3" in r for r in got)


def test_bucket():
    assert stateful.take(100.0, None, 0, 60, 10, 100) == (True, 40.0)
    assert stateful.take(40.0, 0, 1_000_000, 60, 10, 100) == (False, 50.0)
    assert stateful.take(40.0, 0, 60_000_000, 100, 10, 100) == (True, 0.0)


def test_confirmation(spark):
    texts = ["a b c d", "a b c d e", "a b c d e", "x y z", None, "x y z", "x y z w"]
    rows = spark.createDataFrame([(k, i, t) for k in (1, None) for i, t in enumerate(texts)], "k int, preview int, text string")
    assert sorted((r.k or 0, r.preview, r.confirmed) for r in stateful.confirmed(rows, ["k"]).collect()) == [(k, i, t) for k in (0, 1) for i, t in ((1, "a b c d e"), (6, "x y z w"))]


def test_folds_are_streamed_key_by_key(spark, monkeypatch):
    """Keys over several batches and of one row, null keys, rows in any order, empty tables; results of every batch size are the same."""
    from turnwise.operators import folds

    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 9)) for k, n in ((None, 300), (1, 1), (2, 5000), (3, 40), (4, 1)) for i in range(n)]
    expected = {k: (sum(x for q, _, x in rows if q == k), [x for q, _, x in rows if q == k][-1]) for k in {r[0] for r in rows}}

    def one(held, i, x):
        assert i == held[1]
        held[0], held[1], held[2] = held[0] + x, i + 1, x
        return []

    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, x int").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = folds.folded(df, ["k"], ["i"], ["i", "x"], lambda: [0, 0, None], one, "total long, last int", lambda held: [(held[0], held[2])]).collect()
        assert {r.k: (r.total, r.last) for r in got} == expected and len(got) == len(expected)
        every = folds.folded(df, ["k"], ["i"], ["x"], list, lambda held, x: [(x,)], "y int")
        assert every.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folds.folded(df.where("k = 9"), ["k"], ["i"], ["x"], list, lambda held, x: [(x,)], "y int").count() == 0


def test_intervals(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 3, 3)], "k int, start long, end long")
    assert sorted((x.start, x.end) for x in intervals.merged(r, ["k"]).collect()) == [(0, 7), (9, 10)]
    base = spark.createDataFrame([(1, 0, 48000), (2, 0, 6000)], "k int, base_start long, base_end long")
    blocked = spark.createDataFrame([(1, 10000, 20000)], "k int, start long, end long")
    assert sorted((x.k, x.start, x.end) for x in intervals.subtracted(base, blocked, ["k"]).collect()) == [(1, 0, 10000), (1, 20000, 48000), (2, 0, 6000)]
    schema = "room int, client_id int, utterance_id int, started_ms long, ended_ms long, avg_rms double, peak_rms double, received_ms long"
    u = spark.createDataFrame([(1, 1, 1, 0, 1000, 0.5, 0.5, 1), (1, 2, 2, 100, 1100, 0.1, 0.1, 2), (1, 3, 3, 751, 1700, 0.1, 0.1, 3)], schema)
    pairs = {(x.left_id, x.right_id): x.overlap_ratio for x in intervals.same_window(u).collect()}
    assert pairs == {(1, 2): 0.9, (2, 1): 0.9}
    groups = {x.utterance_id: (x.group_no, x.is_dominant, x.echo_suspected) for x in intervals.gate_groups(u).collect()}
    assert groups == {1: (0, True, False), 2: (0, False, True), 3: (1, True, False)}


def test_percentiles(spark):
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 10)], "x int")
    row = v.agg(*metrics.latency_summary("x")).first()
    assert (row.p50_ms, row.p95_ms) == (3, 10)
    assert metrics.histogram_ranks(v.withColumn("k", F.lit(1)), ["k"], "x", {"p": 0.95}).first().p == 10


def test_audio(spark):
    assert audio.levels(b"") == (0.0, 0.0)
    samples = np.array([0, 16384, -32768], "<i2").tobytes()
    assert audio.levels(samples)[1] == 1.0
    wav = audio.wav_bytes(samples + b"x")
    assert audio.decode_wav(wav) == samples and audio.probe(wav)["sample_rate"] == 16000
    assert audio.probe(b"RIFF") is None
    column = spark.createDataFrame([(bytearray(samples + b"x"),)], "p binary").select(audio.to_wav("p").alias("w"), audio.is_wav(audio.to_wav("p")).alias("ok")).first()
    assert bytes(column.w) == wav and column.ok
    stereo = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 2, 48000, 192000, 4, 16, b"data", 48000 * 4) + np.zeros(96000, "<i2").tobytes()
    assert len(audio.decode_wav(stereo)) == 16000 * 2
    packets = [1000, 280, 640]
    rest, frames_after = 0, []
    for p in packets:
        n, rest = audio.frames_after(rest, p)
        frames_after.append((n, rest))
    assert frames_after == [(1, 360), (1, 0), (1, 0)]
    padded = spark.createDataFrame([([0.25] * 1600,)], "x array<double>").select(audio.pad_for_decoder(F.col("x")).alias("p")).first().p
    assert len(padded) == 16000 and padded[:7200] == [0.0] * 7200 and padded[7200] == 0.25


def test_fingerprint_depends_on_field_borders(spark):
    f = spark.createDataFrame([("ab", "c"), ("a", "bc")], "a string, b string").select(hashing.fingerprint(F.col("a"), F.col("b")).alias("f"))
    assert len({r.f for r in f.collect()}) == 2


def test_sessions_order_of_input(spark):
    rows = [(k, i * i * 7 % 101, i) for k in range(3) for i in range(40)]
    go = lambda rs: sorted(map(str, sessions.gap_sessions(spark.createDataFrame(rs, "k long, t long, i long"), ["k"], F.col("t"), ["t", "i"], 3).collect()))
    assert go(rows) == go(list(reversed(rows)))
