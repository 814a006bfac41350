"""Captures, previews, buffers, drains; ranks and percentiles; folds by stretch against folds of the whole."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import numerals
from turnwise.functions import text as T
from turnwise.operators import align, idempotency, intervals, lifecycle, metrics, sessions, vad
from turnwise.plans import conversation
from turnwise.streaming import stateful


def test_captures_end_by_leaving_by_silence_or_not_at_all(spark):
    rows = [("a", 0, 1, False), ("a", 10, 2, True), ("a", 20, 3, False), ("b", 0, 4, False), ("b", 500, 5, False), ("c", 990, 6, False), ("d", 5, 7, False), (None, 1000, 8, None)]
    got = lifecycle.captures(spark.createDataFrame(rows, "client string, ts_ms long, seq long, gone boolean"), "client", F.col("gone"), 100)
    found = {(r.client, r.capture_no): (r.joined_ms, r.left_ms, r.n_events, r.end_reason) for r in got.collect()}
    assert found == {
        ("a", 1): (0, 10, 2, "disconnect"), ("a", 2): (20, 20, 1, "timeout"), ("b", 1): (0, 0, 1, "timeout"), ("b", 2): (500, 500, 1, "timeout"),
        ("c", 1): (990, 990, 1, "open"), ("d", 1): (5, 5, 1, "timeout"), (None, 1): (1000, 1000, 1, "open"),
    }
    assert {r.client for r in lifecycle.present(got, "client").collect()} == {"c", None}


def plain_previews(rows, interval, preview, final):
    out = {}
    for lane in {r[0] for r in rows}:
        last, busy, running = None, -1, None
        for _, now, i, is_final in sorted((r for r in rows if r[0] == lane), key=lambda r: r[1:3]):
            if is_final:
                if running and now < running[1]:
                    out[running[0]] = "cancelled"
                running, busy, out[i] = None, now + final, "final"
            elif now < busy:
                out[i] = "final-busy"
            elif running and now < running[1]:
                out[i] = "preview-busy"
            elif last is not None and now - last < interval:
                out[i] = "interval"
            else:
                out[i], last, running = "scheduled", now, (i, now + preview)
    return out


def test_previews_equal_a_plain_version(spark, monkeypatch):
    rng = random.Random(2)
    rows, at = [], 0
    for i in range(1500):
        at += rng.choice([50, 200, 700, 5000])
        rows.append((i % 3, at, i, rng.random() < 0.15))
    expected = plain_previews(rows, 1200, 600, 900)
    assert set(expected.values()) == {"final", "cancelled", "final-busy", "preview-busy", "interval", "scheduled"}
    df = spark.createDataFrame(rows, "room int, ts_ms long, event_id int, is_final boolean").repartition(4)
    parts = sessions.stretches
    for together in (4096, 3):
        monkeypatch.setattr(lifecycle, "stretches", lambda *a, t=together: parts(*a, together=t))
        assert {r.event_id: r.decision for r in lifecycle.live_previews(df, "room").collect()} == expected


def test_buffer_equals_a_plain_version(spark):
    rng = random.Random(4)
    rows = []
    for c in range(4):
        at = 0
        for i in range(200):
            at += rng.choice([0, 1000, 20_000, 60_000])
            rows.append((c, at, i, rng.choice([640, 640, 1280, 5000])))
    df = spark.createDataFrame(rows, "client int, at long, i int, size long").repartition(3)
    got = {(r.client, r.i): r for r in lifecycle.buffered(df, "client", ["at", "i"], F.col("at"), bound=20_000).collect()}
    stops = 0
    for c in range(4):
        held, before, stopped = 0.0, None, False
        for _, at, i, size in (r for r in rows if r[0] == c):
            held = max(0.0, held - (0 if before is None else (at - before) / 1e6 * 32_000)) + size
            before = at
            r = got[c, i]
            assert r.buffered_bytes == pytest.approx(held)
            assert r.stopped == (not stopped and held > 20_000)
            stopped = stopped or held > 20_000
            assert r.refused == stopped
        stops += stopped
    assert stops


def test_drain_accounts_for_every_item(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id int")
    queue, pending, done = ids([1, 2, 3, 3, 4]), ids([4, 5, 6]), ids([2, 6])
    kept = {r.id: r.reason for r in lifecycle.drained(queue, done, pending, ["id"]).collect()}
    assert kept == {1: "service-stop-queued", 3: "service-stop-queued", 4: "service-stop-queued", 5: "service-stop-pending"}
    assert set(kept) | {2, 6} == {1, 2, 3, 4, 5, 6}


def test_drain_of_a_stream_loses_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    start = lambda: spark.readStream.schema("x int").option("maxFilesPerTrigger", 1).parquet(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    for i in range(3):
        spark.createDataFrame([(i,)], "x int").coalesce(1).write.mode("append").parquet(source)
    stateful.drain(start())
    spark.createDataFrame([(3,)], "x int").coalesce(1).write.mode("append").parquet(source)
    stateful.drain(start())
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


# --- voice activity: judges, files, leaving ---------------------------------------------

LOUD, QUIET = (0.1, 0.2), (0.0005, 0.001)
FRAMES = "client_id long, ts_ms long, frame_no long, rms double, peak double, end boolean"


def test_judged_segments_raise_the_floor(spark):
    """What a rejected segment teaches changes which later frames are speech; batch equals the plain fold."""
    rows = [(1, 20 * i, i, *level, False) for i, level in enumerate([LOUD] * 150 + [QUIET] * 36 + [(0.013, 0.025)] * 150 + [QUIET] * 60)]
    reject = lambda s: "empty" if s["avg_rms"] > 0.05 else None
    df = spark.createDataFrame(rows, FRAMES)
    state, plain = vad.State(), []
    for _, now, _, rms, peak, _ in rows:
        for s in vad.step(state, now, rms, peak):
            plain.append(s)
            if s[7] > 0.05:
                vad.learn_noise(state, s[4], s[7], "empty")
    got = [tuple(r)[1:] for r in vad.segments(df, judge=reject).orderBy("started_ms").collect()]
    assert [g[:3] for g in got] == [p[:3] for p in plain] and len(got) == 1
    assert vad.segments(df).count() == 2  # without a judge the faint speech is heard


def test_file_segments_are_corrected_and_clamped(spark):
    loud, silence = np.full(512, 9000, "<i2"), np.zeros(512, "<i2")
    files = {1: [loud] * 4 + [silence] * 3 + [loud] * 2 + [loud[:100]], 2: [silence] * 5, 3: [loud[:500]], 4: None}
    rows = [(k, None if v is None else np.concatenate(v).tobytes()) for k, v in files.items()]
    got = vad.file_segments(spark.createDataFrame(rows, "f int, pcm binary"), "f", lambda: lambda s: bool(np.abs(s).max() > 0.1)).orderBy("start_s").collect()
    assert [(r.f, round(r.start_s, 9), round(r.end_s, 9), len(r.pcm)) for r in got] == [(1, 0.0, 0.128, 4096), (1, 0.224, 0.288, 2048)]


def stream(spark, tmp_path, parts, schema, build, name):
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.sql(f"select * from {name}").collect()


def test_leaving_flushes_and_forgets(spark, tmp_path):
    """A client leaves in the middle of speech: its tail becomes a segment; when it comes back its turns begin anew."""
    first = [(1, 20 * i, i, *LOUD, i == 99) for i in range(100)]
    again = [(1, 20_000 + 20 * i, i, *LOUD, i == 99) for i in range(100)]
    got = stream(spark, tmp_path, [first[:50], first[50:], again], FRAMES, stateful.vad_stream, "left_out")
    assert sorted((r.turn_no, r.segment_index, r.audio_ms, r.end_reason) for r in got) == [(1, 0, 2000, "capture-stop")] * 2


def test_silent_clients_time_out(spark, tmp_path):
    from datetime import datetime

    schema = FRAMES + ", ts timestamp"
    at = lambda ms: datetime.fromtimestamp(1_700_000_000 + ms / 1000)
    row = lambda c, ms, i: (c, 1_700_000_000_000 + ms, i, *LOUD, False, at(ms))
    parts = [[row(1, 20 * i, i) for i in range(100)], [row(2, 60_000, 0)], [row(2, 120_000, 1)]]
    got = stream(spark, tmp_path, parts, schema, lambda s: stateful.vad_stream(s.withWatermark("ts", "1 second"), timeout_ms=5000), "timeout_out")
    assert [(r.client_id, r.audio_ms, r.end_reason) for r in got] == [(1, 2000, "capture-stop")]


# --- ranks and percentiles ----------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [None], [5] * 40, [3, 1, 2, None, 1, 1, 9, 2**40]])
def test_ranks_over_the_whole_table(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i int")
    got = {r.i: r.place for r in sessions.ranked(df, F.col("v"), ["v", "i"], "place", parts=4).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_percentiles_of_many_values(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(5000)], "b": [7.0] * 9, "c": [rng.choice([1.0, 2.0, 1e9]) for _ in range(300)], "d": [5.5]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("e", None)], "k string, v double").repartition(6)
    got = {r.k: (r.p50, r.p95, r.p100) for r in metrics.histogram_ranks(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    half_up = lambda x: int(x + 0.5)
    assert got == {k: tuple(sorted(v)[half_up((len(v) - 1) * p)] for p in (0.5, 0.95, 1.0)) for k, v in groups.items()}


@pytest.mark.parametrize("most", [0, 3, 5, 7, 100])
def test_evictions(spark, most):
    rows = [(f"k{i}", (i * 7) % 10, i % 4 != 0) for i in range(10)]
    df = spark.createDataFrame(rows, "key_hash string, expires_at_ms long, completed boolean")
    over = max(0, len(rows) - most)
    expected = [k for k, _, _ in sorted((r for r in rows if r[2]), key=lambda r: (r[1], r[0]))[:over]]
    assert sorted(r.key_hash for r in idempotency.to_evict(df, most).collect()) == sorted(expected)


# --- texts and intervals against plain versions ---------------------------------------------


def plain_matches(a, b):
    """Matched elements of the longest common block and, recursively, of what is left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n + plain_matches(a[:i], b[:j]) + plain_matches(a[i + n :], b[j + n :]) if n else 0


def test_similarity_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = [([rng.choice("abcde") for _ in range(rng.randint(0, 14))], [rng.choice("abcde") for _ in range(rng.randint(0, 14))]) for _ in range(80)]
    got = [r.s for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(T.lexical_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([2 * plain_matches(a, b) / (len(a) + len(b)) if a and b else 0.0 for a, b in rows])


def test_best_block_equals_a_plain_search(spark):
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 20))] for _ in range(2))
        size, in_b, in_a = align.best_block(a, b)
        blocks = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert size == max((m.size for m in blocks), default=0)
        assert not size or a[in_a : in_a + size] == b[in_b : in_b + size]
    rows = spark.createDataFrame([(["x"] * 3 + list("abcde"), list("abcde")), ([], ["a"])], "a array<string>, b array<string>")
    assert [tuple(r.b) for r in rows.select(align.block_column("a", "b").alias("b")).collect()] == [(5, 0), (0, -1)]


def test_word_offsets_and_first_differences(spark):
    import re

    texts = ["", None, "  a, bé 12! ", "Über-fluß\n漢字 x", "w " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", T.word_offsets("t").alias("w")).collect():
        assert [(w.word, w.start, w.end) for w in r.w] == [(m[0], *m.span()) for m in re.finditer(r"[^\W_]+", texts[r.i] or "")]
    pairs = spark.createDataFrame([("abc", "abd"), ("", None), ("ab", "abxyz"), ("🙂a", "🙂b")], "a string, b string")
    assert [r.d for r in pairs.select(T.first_difference(F.col("a"), F.col("b")).alias("d")).collect()] == ["2:c|d", "0:|", "2:|xyz", "1:a|b"]


@pytest.mark.parametrize("together", [1, 40, 1 << 20])
def test_words_of_many_texts_are_found_at_once(monkeypatch, together):
    """Texts that end and begin with words, null and empty ones, any script, slices, blocks of any size."""
    import re

    import pyarrow as pa

    monkeypatch.setattr(T, "_TOGETHER", together)
    texts = ["", "ab", "cd e", None, "x" * 90, " \x00é🙂ß1 Ⅷ²漢_字\u0301a ", "", None, "🙂", "z"]
    for kind in (pa.string(), pa.large_string()):
        for part in (slice(0, 10), slice(3, 9), slice(0, 1), slice(0, 0), slice(7, 8)):
            got = T._word_offsets(pa.array(texts, kind)[part])
            got.validate(full=True)
            want = [[{"word": m[0], "start": m.start(), "end": m.end()} for m in re.finditer(r"[^\W_]+", t or "")] for t in texts[part]]
            assert got.to_pylist() == want
    assert T._word_offsets(pa.array([b"a\xffb c"], pa.binary())).to_pylist() == [[{"word": "a", "start": 0, "end": 1}, {"word": "b", "start": 2, "end": 3}, {"word": "c", "start": 4, "end": 5}]]


def test_repeats_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows = [([rng.choice(["a", "ab", "b", "ba"]) for _ in range(rng.randint(0, 26))],) for _ in range(400)]
    rows += [(["a", "b", "c"] * 3,), (["a", "b", "c"] * 2 + ["a", "b", "cd"],), (["x"] + list("abcdefgh") * 3,), (list("abcdefghi") * 3,)]
    spans = spark.createDataFrame(rows, "w array<string>").select("w", *[T.has_repeat(F.col("w"), s).alias(f"s{s}") for s in range(1, 4)], T.has_repeat(F.col("w"), 3, longest=8).alias("b"))
    repeats = lambda w, s: any(w[i : i + s] == w[i + s : i + 2 * s] == w[i + 2 * s : i + 3 * s] for i in range(len(w) - 3 * s + 1))
    for r in spans.collect():
        assert [r.s1, r.s2, r.s3] == [repeats(r.w, s) for s in (1, 2, 3)]
        assert r.b == any(repeats(r.w, s) for s in range(3, 9))


def test_english_runs(spark):
    text = "It cost two hundred and five thousand, then forty-two; one and two. Tension and someone are no numbers."
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(F.regexp_extract_all("t", F.lit(numerals.EN_RUN), F.lit(0))).alias("p")).select("p", numerals.en_value("p").alias("v"))
    assert [(r.p, r.v) for r in found.collect()] == [("two hundred and five thousand", 205000), ("forty-two", 42), ("one and two", 3)]


def test_gate_groups_by_stretch_equal_the_whole_room(spark, monkeypatch):
    rng = random.Random(6)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([0, 100, 400, 651, 3000])
        start = at + rng.randint(-50, 50)
        rows.append((i % 2, i % 5, i, start, start + rng.randint(500, 1500), rng.random(), rng.random(), at + rng.randint(0, 900)))
    schema = "room int, client_id int, utterance_id int, started_ms long, ended_ms long, avg_rms double, peak_rms double, received_ms long"
    df = spark.createDataFrame(rows, schema).repartition(3)
    parts = sessions.stretches
    results = []
    for together in (10**6, 2):
        monkeypatch.setattr(intervals, "stretches", lambda *a, t=together: parts(*a, together=t))
        results.append(sorted(map(tuple, intervals.gate_groups(df).collect())))
    assert results[0] == results[1] and len(results[0]) == 400


def test_blocks_of_other_speakers_and_clean_ranges(spark):
    """Diarised regions: what only one speaker covers, sample by sample, in pieces long enough."""
    rng = random.Random(7)
    rows = []
    for room in range(2):
        for _ in range(60):
            start = rng.randint(0, 3000)
            rows.append((room, rng.randint(0, 3), start, start + rng.randint(1, 200)))
    df = spark.createDataFrame(rows, "room int, label int, start long, end long")
    own = intervals.merged(df, ["room", "label"])
    covered = defaultdict(set)
    for room, label, start, end in rows:
        covered[room, label].update(range(start, end))
    for slot in (17, 60_000):
        blocked = intervals.blocked_by_others(own, ["room"], slot).select("room", "label", "start", "end")
        clean = intervals.subtracted(own.select("room", "label", F.col("start").alias("base_start"), F.col("end").alias("base_end")), blocked, ["room", "label"], 1)
        found = defaultdict(set)
        for r in clean.collect():
            found[r.room, r.label].update(range(r.start, r.end))
        for (room, label), points in covered.items():
            others = set().union(*(p for (q, l), p in covered.items() if q == room and l != label))
            assert found[room, label] == points - others


def _above_the_join(df):
    """The plan from the top down to the first join."""
    return df._jdf.queryExecution().executedPlan().toString().split("Join")[0]


def test_blocks_of_speakers_with_equal_segments_are_no_pairs(spark):
    """Many labels with the same segments, empty and null ones too: found once for each segment, and not shuffled to be told apart."""
    rng = random.Random(11)
    rows = [(0, label, s, e) for s, e in ((0, 50), (20, 70), (20, 20), (65, 180)) for label in range(rng.randint(1, 40))]
    rows += [(1, 7, 0, 50), (1, 7, 10, 60), (1, None, 0, 50), (None, 3, 0, 50), (None, 4, 0, 50)] + [(2, label, 5, 9) for label in (1, 1, 2)]
    df = spark.createDataFrame(rows, "room int, label int, start long, end long")
    expected = {
        (r, a, s, e, max(s, t), min(e, f)) for r, a, s, e in rows for q, b, t, f in rows
        if None not in (r, q, a, b) and r == q and a != b and s < f and t < e
    }
    for slot in (17, 60_000):
        got = intervals.blocked_by_others(df, ["room"], slot)
        found = list(map(tuple, got.collect()))
        assert len(found) == len(set(found)) and set(found) == expected
        assert "Exchange" not in _above_the_join(got)


def test_blocks_of_speakers_are_found_once(spark):
    """Ranges that begin or end alike, inside, around and equal to a segment: each overlap comes once, though results aren't compared."""
    rng = random.Random(17)
    rows = [(room, rng.randint(1, 3 + room), s, s + rng.randint(-3, 30)) for room in range(3) for s in (rng.randint(-20, 40) for _ in range(70))]
    rows += [(4, 1, 0, 9), (4, 1, 2, 9), (4, 2, 4, 9), (4, 2, 3, 20), (4, 1, 3, 30), (None, 1, 0, 9), (4, None, 0, 9), (4, 3, None, 9), (4, 3, 0, None)]
    df = spark.createDataFrame(rows, "room int, label int, start long, end long")
    expected = sorted({
        (r, a, s, e, max(s, t), min(e, f)) for r, a, s, e in rows for q, b, t, f in rows
        if None not in (r, a, s, e, q, b, t, f) and r == q and a != b and s < f and t < e
    })
    for slot in (5, 17, 60_000):
        got = intervals.blocked_by_others(df, ["room"], slot)
        assert sorted(map(tuple, got.collect())) == expected
        assert "Aggregate" not in _above_the_join(got)


def test_uncontested_ranges_are_what_subtraction_leaves(spark):
    rng = random.Random(5)
    rows = []
    for room in range(2):
        for _ in range(60):
            start = rng.randint(-500, 2500)
            rows.append((room, rng.randint(-2, 3), start, start + rng.randint(0, 200)))
    rows += [(2, 2**40 + label, 0, 100) for label in range(3)] + [(2, 2**62 + 1, 100, 200), (2, -(2**62), 200, 300), (3, 5, 0, 500)]
    own = intervals.merged(spark.createDataFrame(rows, "room int, label long, start long, end long"), ["room", "label"])
    base = own.select("room", "label", F.col("start").alias("base_start"), F.col("end").alias("base_end"))
    blocked = intervals.blocked_by_others(own, ["room"]).select("room", "label", "start", "end")
    expected = sorted(map(tuple, intervals.subtracted(base, blocked, ["room", "label"], 5).select("room", "label", "start", "end").collect()))
    assert {(2, 2**62 + 1, 100, 200), (2, -(2**62), 200, 300), (3, 5, 0, 500)} <= set(expected)
    for slot in (7, 60_000):
        got = intervals.uncontested(own, ["room"], 5, slot)
        assert sorted(map(tuple, got.select("room", "label", "start", "end").collect())) == expected
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_events_of_a_busy_room_are_many_tasks(spark, tmp_path):
    """One room: each event goes to all other clients once, and not all in one task."""
    rows = [(i, 3 * (i % 40), "error" if i % 2 else "view") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = conversation.fanout(spark, str(tmp_path))
    expected = sorted((i, 3 * c) for i, u, kind in rows if kind == "error" for c in range(40) if 3 * c != u)
    assert sorted(map(tuple, out.collect())) == expected
    assert len({r.p for r in out.select(F.spark_partition_id().alias("p")).collect()}) > 20


def test_events_of_a_room_go_to_few_clients_at_a_time(spark, tmp_path):
    """Files of a room with many clients repeat a few of them for one event after another, which takes little disk."""
    rows = spark.range(1_200).selectExpr("id as event_id", "3 * (id % 600) as user_id", "if(id % 2 = 0, 'error', 'view') as event_type")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    out = conversation.fanout(spark, str(tmp_path)).withColumn("p", F.spark_partition_id()).toPandas()
    assert set(zip(out["event_id"], out["client_id"], strict=True)) == {(i, 3 * c) for i in range(0, 1_200, 2) for c in range(600) if c != i % 600}
    assert len(out) == 600 * 599
    run = ((out["event_id"] != out["event_id"].shift()) | (out["p"] != out["p"].shift())).cumsum()
    assert out.groupby(run).size().median() <= 256


def test_stretches_of_packets_equal_the_whole(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([1000, 200_000, 3_000_000])
        rows.append((i % 2, at, i, rng.choice([1000, 100_000, 300_000])))
    df = spark.createDataFrame(rows, "client_id int, ts_us long, event_id int, size long")
    expected = {}
    for c in range(2):
        tokens, before = 320_000.0, None
        for _, now, i, size in (r for r in rows if r[0] == c):
            ok, tokens = stateful.take(tokens, before, now, size, 128_000.0, 320_000.0)
            before, expected[i] = now, ok
    assert {r.event_id: r.accepted for r in stateful.admitted(df).collect()} == expected
