"""Control sessions, lines, replies, bodies, headers, errors and differences, against plain versions and on odd rows."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from turnwise.functions import wire
from turnwise.operators import protocol


def column(spark, expr, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expr.alias("y")).orderBy("i").collect()]


def plain_session(rows):
    """A client's messages one by one: (before, state, reply, mic, room, name, language, told)."""
    state, mic, room, name, language, out = "off", "off", "default", "Guest", "vi", []
    for message, refusal in rows:
        try:
            m = json.loads(message)
        except (TypeError, ValueError):
            m = {}
        m = m if isinstance(m, dict) else {}
        verb, before, reply, told = m.get("type"), state, None, []
        known = m.get("language") if m.get("language") in ("vi", "en") else "vi"
        if verb == "join" and state != "off":
            reply = "join-during-capture"
        elif verb == "join":
            old, mic, reply = room, "off", "joined"
            room, name, language = m.get("room") or "default", m.get("name") or "Guest", known
            told = [room] if room == old else [room, old]
        elif verb == "language_pref":
            language, told = known, [room]
        elif verb == "capture_start":
            ok = state == "off" and refusal is None
            reply = {"capture": "already-active", "speech": "capture-mode-conflict"}.get(state) or refusal or "capture_ready"
            if "language" in m and (ok or state == "capture"):
                language = known
            if ok:
                state, mic, told = "capture", "listening", [room]
        elif verb == "capture_stop":
            state, mic, told = "off", "off", [room]
        elif verb == "speech_start":
            reply = "speech-already-active" if state != "off" else refusal
            if state == "off" and refusal is None:
                state, mic, told = "speech", "speaking", [room]
                language = known if "language" in m else language
        elif verb == "speech_end" and state == "speech":
            state, mic, told = "off", "listening", [room]
        elif verb == "ping":
            reply = "pong"
        out.append((before, state, reply, mic, room, name, language, told))
    return out


def test_control_sessions_equal_messages_one_by_one(spark):
    rnd = random.Random(5)
    kinds = [{"type": "join", "room": "a"}, {"type": "join", "room": "b", "name": "Ann", "language": "en"}, {"type": "language_pref", "language": "en"}, {"type": "language_pref"}, {"type": "capture_start"}]
    kinds += [{"type": "capture_start", "language": None}, {"type": "capture_stop"}, {"type": "speech_start", "language": "en"}, {"type": "speech_start"}, {"type": "speech_end"}, {"type": "ping"}, {"type": "x"}, [1], 7]
    texts = [json.dumps(k) for k in kinds] + [None, "", "{", "null"]
    rows, want = [], []
    for client in [None, "c1", "c2", "c3"]:
        said = [(rnd.choice(texts), rnd.choice([None, None, None, "storage-pressure"])) for _ in range(250)]
        rows += [(client, 1000 + i, m, r) for i, (m, r) in enumerate(said)]
        want += [(client, 1000 + i, *x) for i, x in enumerate(plain_session(said))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "client string, at bigint, message string, refusal string").repartition(5)
    names = ["client", "at", "before", "state", "reply", "mic", "current_room", "current_name", "current_language", "told"]
    got = protocol.sessions(df, "client", ["at"], refusal="refusal").select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert protocol.sessions(df.limit(0), "client", ["at"], refusal="refusal").count() == 0


def test_control_fields(spark):
    texts = ['{"type":"speech_start","utterance_id":" -a b- ","started_ms":"12"}', '{"type":"speech_start"}', '{"type":"ping","client_ts":1.5}', '{"type":"join","room":"  x/y z ","name":"  "}', None]
    got = column(spark, wire.control("x", F.lit("u"), F.lit(99)), texts)
    assert (got[0].utterance_id, got[0].started_ms) == ("a-b", 12) and (got[1].utterance_id, got[1].started_ms) == ("u", 99)
    assert got[2].client_ts == 1.5 and (got[3].room, got[3].name, got[3].language) == ("x-y-z", "Guest", "vi")
    assert set(got[4]) == {None}


def test_names(spark):
    assert column(spark, wire.room_name("x"), [None, "", "  ", "a  b", "x" * 99]) == ["default", "default", "default", "a--b", "x" * 64]
    assert column(spark, wire.guest_name("x"), [None, " An Bình "]) == ["Guest", "An Bình"]
    assert column(spark, wire.language_pref("x", auto=True), [None, "EN ", "auto", "fr"]) == ["vi", "en", "auto", "vi"]
    assert column(spark, wire.utterance_name("x", F.lit("f")), [None, "---", "a.b", "-" * 79 + "ab"]) == ["f", "f", "a-b", "a"]


def test_origins(spark):
    rule = wire.origin_allowed("x", ["https://a.test"], [".ok.test"], local=True, own=F.lit("http://own:80/"))
    texts = [None, "", "https://a.test//", "https://b.ok.test", "http://b.ok.test", "http://[::1]:3", "http://LOCALHOST", "http://own:80", "no url at all", "https://evilok.test"]
    assert column(spark, rule, texts) == [True, True, True, True, False, True, True, True, False, False]


def test_lines_and_replies(spark):
    got = column(spark, wire.request_line("x"), ["PCM\t/a\t EN \tc\tmore", "WAV\t/a", "/a\tVI", "/a", "", None])
    assert [tuple(r) for r in got] == [("pcm", "/a", "en", "c", None), (None, None, None, None, "bad-request"), ("pcm", "/a", "vi", "", None), ("pcm", "/a", "vi", "", None), ("pcm", "", "vi", "", None), (None,) * 5]
    got = column(spark, wire.recogniser_reply("x"), ["OK\tVI\t a  b \tGreedy", "OK\ten\t \t", "OK\ten", "ERR\t", "ERR\ta\tb", "SKIP\t", "en\ta\tb", "ERR", "", None])
    assert [tuple(r) for r in got] == [
        (True, "vi", "a b", None, "greedy"), (False, "en", "", "empty", ""), (False, "", "", "invalid-reply", None), (False, "", "", "worker-error", None), (False, "", "", "a\tb", None),
        (False, "", "", "worker-skip", None), (True, "en", "a b", None, None), *[(False, "", "", "invalid-reply", None)] * 3,
    ]


def test_bodies(spark):
    rows = spark.createDataFrame([("verbose_json", "a", 2.5, [(0.0, 1.0, 'q"')]), ("verbose_json", "a", 2.4, None), ("text", "a", 0.0, []), (None, "a", 0.0, [])], "kind string, text string, d double, s array<struct<start:double,end:double,text:string>>")
    got = [r.b for r in rows.select(wire.response_body(F.col("kind"), F.col("text"), F.lit("vi"), F.col("d"), F.col("s")).alias("b")).collect()]
    first, second = json.loads(got[0]), json.loads(got[1])
    assert first["segments"] == [{"id": "segment_0", "type": "transcript.text.segment", "start": 0.0, "end": 1.0, "text": 'q"'}] and first["usage"] == {"type": "duration", "seconds": 3}
    assert "segments" not in second and second["usage"]["seconds"] == 2 and got[2:] == ["a", '{"text":"a"}']


def test_weighted_languages(spark):
    texts = [None, "", "vi", "en,vi", "en;q=1, vi;q=0.9", "vi;q=-1", "vi;q=-1,en;q=0", "vi;q=x,en", "en;q=0.1;q=1,vi;q=0.2", "VI-vn;q=.5,en;q=5e-1"]
    assert column(spark, wire.prefers("x"), texts) == [False, False, True, True, False, True, True, True, True, True]


def test_errors(spark):
    texts = [*[marks[0] for _, marks, *_ in wire.ERRORS], "x", None, "request body exceeds max_upload_mb = 12", "request body exceeds max_upload_mb = 12x", "audio duration exceeds 7.5 seconds now"]
    got = column(spark, wire.localised_error("x", F.lit(True)), texts)
    codes = [code for code, *_ in wire.ERRORS]
    assert [r.code for r in got] == [*codes, "internal_error", "internal_error", "request_too_large", "internal_error", "audio_too_long"]
    assert got[-1].message == "Thời lượng âm thanh vượt quá giới hạn 7.5 giây." and "12 MB" in got[-3].message
    english = column(spark, wire.localised_error("x", F.lit(None).cast("boolean")), texts)
    assert english[2].message == texts[2] and english[0].message == 'Parameter "model" is required.'
    assert [r.status for r in column(spark, wire.decode_error("x"), ["failed to launch ffmpeg", "bad", None])] == [500, 400, 400]
    assert [r.status for r in column(spark, wire.runtime_error("x"), ["CAPU request timed out: 3", None])] == [504, 500]


def test_segment_state(spark):
    rows = [("corrected-right-context", None, None), ("speaker-unresolved", "verified", None), (None, None, True), (None, "uncertain", None), (None, "uncertain", True), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c boolean")
    got = df.select("i", wire.segment_state(F.col("a"), F.col("b"), F.col("c")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["corrected", "uncertain", "verified", "uncertain", "verified", "provisional"]


def test_word_starts(spark):
    assert column(spark, wire.word_starts(F.col("x")), [[None, 0, 0, 1, None], [], [None, None], [3]], "array<int>") == [[0, 1, 3, 4], [0], [0], [0]]


def test_speakers_body(spark):
    schema = "s int, d string, r array<struct<start:int,end:int,label:int>>, l array<struct<label:int,clean_samples:bigint,speaker_id:string,match:string,score:double,raw_best:double,raw_second:double,raw_margin:double>>"
    rows = [(2, 'A"', [(0, 16000, 1), (8, 24000, 0)], [(1, 17, None, None, None, None, None, None), (0, 32000, 'A"', "m", 0.5, 0.25, -0.125, 0.375)]), (0, None, [], [])]
    df = spark.createDataFrame(rows, schema)
    got = [json.loads(r.b) for r in df.select(wire.speakers_body(F.col("s"), F.col("d"), F.col("r"), F.col("l")).alias("b")).collect()]
    assert got[0]["regions"] == [{"start": 0.0, "end": 1.0, "local": 1, "speaker_id": "UNKNOWN"}, {"start": 0.001, "end": 1.5, "local": 0, "speaker_id": 'A"'}]
    assert [x["local"] for x in got[0]["locals"]] == [0, 1] and got[0]["locals"][0]["raw_second"] == -0.125 and got[0]["locals"][1] == {"local": 1, "clean_ms": 1, "speaker_id": "UNKNOWN"}
    assert got[1] == {"engine": "seg-reid-v1", "diarized_speakers": 0, "dominant": "UNKNOWN", "regions": [], "locals": []}


def test_picked_files(spark):
    rows = [("a", "z.bin"), ("a", "x-2.bin"), ("a", "x-1.bin"), ("b", "x-1.bin"), ("b", "second"), ("c", "other"), ("d", None), (None, "first"), (None, "second")]
    df = spark.createDataFrame(rows, "folder string, name string")
    got = {r.folder: r.picked for r in protocol.picked(df, "folder", "name", ["first", "second"], [("x-", ".bin")]).collect()}
    assert got == {"a": "x-1.bin", "b": "second", "c": None, "d": None, None: "first"}
    assert protocol.picked(df.limit(0), "folder", "name", ["first"]).count() == 0


def test_first_edits_against_the_sequence_matcher():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rnd.choice("ab,") for _ in range(rnd.randrange(12))) for _ in range(2))
        if rnd.random() < 0.3:
            b = a
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        edits = [x for x in m.get_opcodes() if x[0] != "equal"]
        got = protocol._first_edit(a, b)
        assert got[:5] == (edits[0] if edits else (None,) * 5) and got[5] == pytest.approx(m.ratio())


def test_difference(spark):
    df = spark.createDataFrame([("x" * 100 + "a, b" + "y" * 100, "x" * 100 + "a b" + "y" * 100), ("A.", "a"), ("a", "a"), (None, "b"), (None, None)], "a string, b string")
    got = [r.d for r in df.select(protocol.difference(F.col("a"), F.col("b")).alias("d")).collect()]
    assert (got[0].tag, got[0].left_span, got[0].right_span, len(got[0].left_context), len(got[0].right_context), got[0].normalized_equal) == ("delete", [101, 102], [101, 101], 181, 180, True)
    assert (got[1].tag, got[1].normalized_equal, got[1].similarity) == ("replace", True, 0.0)
    assert (got[2].tag, got[2].left_span, got[2].left_context, got[2].similarity) == (None, None, None, 1.0)
    assert (got[3].tag, got[3].right_context, got[3].normalized_equal) == ("insert", "b", False) and got[4].tag is None
