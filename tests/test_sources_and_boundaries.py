"""Sources and sinks on real files, model boundaries with failing and late stand-ins."""

import io as files
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import audio, boundary
from turnwise.operators import align
from turnwise.sources import io

# --- audio ---------------------------------------------------------------------------


def wav(data, tag=1, bits=16, rate=16000, channels=1):
    align_ = bits // 8 * channels
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, tag, channels, rate, rate * align_, align_, bits, b"data", len(data)) + data


def test_codecs_decode_to_the_same_samples():
    x = np.array([0, 256, -256, 16384, -32768, 32512], np.int32)
    expected = x.astype("<i2").tobytes()
    assert audio.decode_wav(wav(expected)) == expected
    assert audio.decode_wav(wav((x // 256 + 128).astype(np.uint8).tobytes(), bits=8)) == expected
    three = b"".join(int(v * 256).to_bytes(3, "little", signed=True) for v in x)
    assert audio.decode_wav(wav(three, bits=24)) == expected
    assert audio.decode_wav(wav((x * 65536).astype("<i4").tobytes(), bits=32)) == expected
    for kind, bits in (("<f4", 32), ("<f8", 64)):
        assert audio.decode_wav(wav((x / 32768).astype(kind).tobytes(), tag=3, bits=bits)) == expected
    assert audio.decode_wav(wav(b"\x00" * 8, tag=85)) is None and audio.decode_wav(b"") is None and audio.decode_wav(None) is None


def test_telephone_codecs():
    """Known values: silence, the smallest and the largest steps of both laws."""
    mu = np.frombuffer(audio.decode_wav(wav(bytes([0xFF, 0x7F, 0x80, 0x00, 0xFE]), tag=7, bits=8)), "<i2").tolist()
    assert mu == [0, 0, 32124, -32124, 8]
    a = np.frombuffer(audio.decode_wav(wav(bytes([0xD5, 0x55, 0xAA, 0x2A]), tag=6, bits=8)), "<i2").tolist()
    assert a == [8, -8, 32256, -32256]


def test_resample_keeps_a_line(spark):
    row = spark.createDataFrame([([float(i) for i in range(480)],)], "x array<double>").select(audio.resample_pcm("x", 48000).alias("y")).first()
    assert row.y == [3.0 * i for i in range(160)]


def test_audio_files_are_decoded_normalised_or_told(spark, tmp_path):
    good = (np.arange(32000) % 2000).astype("<i2").tobytes()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav(good))
    (tmp_path / "in" / "b.wav").write_bytes(wav(good, rate=32000))
    (tmp_path / "in" / "c.wav").write_bytes(b"no audio at all")
    (tmp_path / "in" / "d.wav").write_bytes(wav(good * 20))
    found = io.audio_files(spark, str(tmp_path / "in"), "*.wav")
    name = F.regexp_extract("path", "([a-z])\\.wav$", 1)
    assert {r.n: r.is_wav for r in found.select(name.alias("n"), "is_wav").collect()} == {"a": True, "b": True, "c": False, "d": True}
    assert {r.n: r.size for r in io.decoded(found).select(name.alias("n"), F.octet_length("pcm").alias("size")).collect()} == {"a": 64000, "b": 32000, "d": 1280000}
    assert [(r.reason, r.payload[-5:]) for r in io.undecodable(found).collect()] == [("undecodable-audio", "c.wav")]
    out = {r.n: bytes(r.wav) for r in io.normalised(found, max_seconds=10).select(name.alias("n"), "wav").collect()}
    assert set(out) == {"a", "b"} and audio.decode_wav(out["a"]) == good  # d is too long
    assert {r.n for r in io.normalised(found, max_bytes=40_000).select(name.alias("n")).collect()} == {"b"}


def test_segments_rejects_and_orphans(spark, tmp_path):
    """A segment's samples and file are in one row; what is turned away is kept by reason; files that no segment names are found."""
    pcm = [(i, bytes(range(i, i + 10))) for i in range(4)]
    rows = spark.createDataFrame([(f"s{i}", p) for i, p in pcm], "segment_id string, pcm binary")
    io.write_segments(rows, str(tmp_path / "segments"))
    back = spark.read.parquet(str(tmp_path / "segments"))
    assert all(bytes(r.wav) == audio.wav_bytes(bytes(r.pcm)) for r in back.collect()) and back.count() == 4
    spool = spark.createDataFrame([("s1", "/spool/1"), ("s9", "/spool/9")], "segment_id string, path string")
    lost = io.orphans(spool, back)
    assert [r.path for r in lost.collect()] == ["/spool/9"]
    packets = spark.createDataFrame([(bytes(3),), (bytes(4),), (bytes(io.PACKET_BYTES + 2),)], "pcm binary")
    for part in (io.invalid_packets(packets), lost.select(F.lit("orphan").alias("reason"), F.col("path").alias("payload"), F.lit(None).cast("bigint").alias("at_ms"))):
        io.write_rejects(part, str(tmp_path / "rejects"))
    kept = spark.read.parquet(str(tmp_path / "rejects")).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in kept} == {"pcm16-odd-byte-count": 1, "pcm-message-too-large": 1, "orphan": 1}


def test_frames_equal_the_bytes_cut_up(spark):
    rng = np.random.default_rng(3)
    rows = []
    for client in range(3):
        for n in range(40):
            rows.append((client, n * 10, n, bytes(rng.integers(0, 256, int(rng.choice([0, 1, 2, 100, 640, 641, 1280, 3000])), dtype=np.uint8))))
    got = io.frames_of(spark.createDataFrame(rows, "client_id int, ts int, packet_no int, pcm binary").repartition(5)).collect()
    for client in range(3):
        data = b"".join(p for c, _, _, p in rows if c == client and len(p) % 2 == 0)
        frames = {r.frame_no: bytes(r.pcm) for r in got if r.client_id == client}
        assert frames == {i: data[640 * i : 640 * i + 640] for i in range(-(-len(data) // 640))}
        assert [r.frame_no for r in got if r.client_id == client and r.partial] == ([len(data) // 640] if len(data) % 640 else [])


# --- other sources ---------------------------------------------------------------------


def test_json_sources(spark, tmp_path):
    from turnwise import schema

    names = [f.split()[0] for f in schema.GOLDEN_SNIPPET.split(", ")] if isinstance(schema.GOLDEN_SNIPPET, str) else schema.GOLDEN_SNIPPET.fieldNames()
    (tmp_path / "g.jsonl").write_text(json.dumps({n: None for n in names}) + "\n")
    assert io.golden_snippets(spark, str(tmp_path / "g.jsonl")).columns == names
    report = {"assets": [{"asset": "a", "cases": [{"label": f"x/{k}", "char_count": 3, "text": "abc"} for k in ("30s", "2m", "full")]}, {"asset": "b", "cases": []}]}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    assert sorted((r.asset, r.label) for r in io.nested_cases(spark, str(tmp_path / "r.json")).collect()) == [("a", "x/2m"), ("a", "x/30s")]


def test_configuration_is_one_file_with_settings(spark, tmp_path):
    (tmp_path / "one.toml").write_text('top = 1\n[model]\nname = "x"\nbeams = [1, 2]\n')
    assert {(r.section, r.key, r.value) for r in io.config(spark, str(tmp_path / "one.toml")).collect()} == {("", "top", "1"), ("model", "name", "x"), ("model", "beams", "[1, 2]")}
    (tmp_path / "empty.toml").write_text("")
    with pytest.raises(ValueError, match="no settings"):
        io.config(spark, str(tmp_path / "empty.toml"))
    (tmp_path / "two.toml").write_text("a = 1\n")
    with pytest.raises(ValueError, match="not one file"):
        io.config(spark, str(tmp_path))


def test_assets_and_archives(spark, tmp_path):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    lock = spark.createDataFrame([(1, "a", sha(b"A")), (2, "b", sha(b"B")), (3, "c", sha(b"C"))], "id int, path string, sha256 string")
    held = spark.createDataFrame([("a", b"A"), ("b", b"changed")], "path string, content binary")
    got = {r.id: (r.status.kind, r.status.actual_sha256) for r in io.asset_status(lock, held).collect()}
    assert got == {1: ("valid", None), 2: ("corrupted", sha(b"changed")), 3: ("missing", None)}
    out = files.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, data in (("m/x", b"X"), ("m/y", b"other")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, files.BytesIO(data))
        archive.addfile(tarfile.TarInfo("m"), None)
    members = io.archive_members(spark.createDataFrame([("t", out.getvalue()), ("broken", b"nothing"), ("none", None)], "path string, content binary"))
    assert {(r.archive, r.member, r.error is None) for r in members.collect()} >= {("t", "m/x", True), ("t", "m/y", True), ("broken", None, False), ("none", None, False)}
    wanted = spark.createDataFrame([("t", "m/x", sha(b"X")), ("t", "m/y", sha(b"Y")), ("t", "m/z", sha(b"Z"))], "archive string, member string, sha256 string")
    assert {r.member: (r.state, r.content and bytes(r.content)) for r in io.extracted(wanted, members).collect()} == {"m/x": ("found", b"X"), "m/y": ("corrupted", None), "m/z": ("missing", None)}


def test_verb_map(spark, tmp_path):
    (tmp_path / "verbs.txt").write_text("go_goes:VB_VBZ\ngo_went:VB_VBD \nno colon\ngo_x:VB_VBZ\nnounder:VB_VBZ\na_b:c\n")
    verbs = io.verb_decode_map(spark, str(tmp_path / "verbs.txt"))
    assert verbs == {"go_VB_VBZ": "goes", "go_VB_VBD": "went"}
    assert align.apply_edits(["he", "go"], ["$KEEP", "$KEEP", "$TRANSFORM_VERB_VB_VBZ"], verbs) == ["he", "goes"]


def test_publish_reaches_the_room_s_clients(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "text", "hello"), ("r2", "text", "there")], "room string, type string, payload string")
    rows.write.parquet(str(tmp_path / "events"))
    clients = spark.createDataFrame([(1, "r1", False), (2, "r1", True), (3, "r2", False)], "client_id int, room string, closing boolean")
    sent = []
    query = io.publish(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")), clients, lambda df, n: sent.extend(df.collect()), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.client_id, r.payload) for r in sent) == [(1, "hello"), (3, "there")]


# --- model boundaries ------------------------------------------------------------------


def test_retried_once_and_only_if_unavailable():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 2:
            raise boundary.Unavailable("busy")
        return x

    assert boundary.retried(flaky, 5) == 5 and calls == [5, 5]
    for error, times in ((TimeoutError, 2), (ValueError, 1)):
        seen = []

        def fails(seen=seen, error=error):
            seen.append(1)
            raise error("no")

        with pytest.raises(error):
            boundary.retried(fails)
        assert len(seen) == times


def test_called_keeps_rows_whose_call_fails(spark):
    def build():
        def model(row):
            if row["x"] == 3:
                raise ValueError("bad")
            return {"y": row["x"] * 2} if row["x"] != 4 else {}

        return model

    rows = spark.createDataFrame([(i,) for i in range(6)], "x int")
    got = {r.x: (r.y, r.error) for r in boundary.called(rows, "double", build, ["x"], "y int").collect()}
    assert got == {0: (0, None), 1: (2, None), 2: (4, None), 3: (None, "ValueError: bad"), 4: (None, None), 5: (10, None)}


class Wire:
    """A worker at the other end of a line, with replies that can be late or broken."""

    def __init__(self, *replies):
        self.replies, self.connected, self.sent = list(replies), 0, []

    def connect(self):
        self.connected += 1
        return self.sent.append, self.receive

    def receive(self):
        reply = self.replies.pop(0) if self.replies else None
        if isinstance(reply, Exception):
            raise reply
        return boundary.serve(self.sent[-1], boundary.Lower()) if reply is None else reply


def test_line_worker_connects_anew_after_a_failure():
    wire = Wire()
    tool = boundary.LinePostprocessor(wire.connect)
    assert tool.ready() and tool.process_text(" Xin  CHÀO ") == "xin chào" and wire.connected == 1
    wire.replies = [TimeoutError("late")]
    assert boundary.retried(tool.process_text, "A") == "a" and wire.connected == 2
    wire.replies = ["not json"]
    with pytest.raises(boundary.Unavailable):
        tool.process_text("B")
    wire.replies = ['{"ok": false, "error": "out of memory"}']
    with pytest.raises(boundary.Unavailable, match="out of memory"):
        tool.process_text("C")
    assert tool.process_text("D") == "d" and wire.connected == 4


def test_serve_answers_every_line():
    ask = lambda line: json.loads(boundary.serve(line, boundary.Keep()))
    assert ask('{"command": "ping"}') == {"ok": True}
    assert ask('{"command": "process_text", "text": " a  b"}') == {"ok": True, "text": "a b"}
    assert not ask("{")["ok"] and not ask('{"command": "other"}')["ok"] and not ask('{"command": "process_text"}')["ok"]


def test_postprocessors_by_mode(spark):
    rows = spark.createDataFrame([(" A  b​ ",), (None,)], "t string")
    got = rows.select(*[boundary.postprocessed(F.col("t"), m).alias(m) for m in boundary.MODES]).collect()
    assert tuple(got[0]) == ("a b", "A b", " A  b​ ") and tuple(got[1]) == ("", "", "")
    assert boundary.combined(["A", "", "b  C"], "clean_lower") == "a b c"


def test_embeddings_and_regions(spark):
    rows = spark.createDataFrame([(1, 900, bytes(10)), (2, 1500, bytes(400_000)), (3, 2000, bytes(6))], "id int, audio_ms int, pcm binary")
    size = lambda: lambda row: {"v": [float(len(row["pcm"]))]}
    assert {r.id: r.v for r in boundary.embedded(rows, size).collect()} == {2: [256_000.0], 3: [6.0]}
    split = lambda: lambda row: {"regions": [{"start": 0, "end": 3, "label": 1}, {"start": 3, "end": len(row["pcm"]), "label": 0}]}
    got = sorted((r.id, r.start, r.end, r.label) for r in boundary.diarised(rows.where("id <> 2"), split).collect())
    assert got == [(1, 0, 3, 1), (1, 3, 10, 0), (3, 0, 3, 1), (3, 3, 6, 0)]


def test_translations_equal_a_plain_version(spark):
    from turnwise.functions.numerals import anchor_reason

    texts = ["", "short one", "in 2018 we met NATO", "word " * 300 + "end.", "a, b. " * 60, "giảm 15 phần trăm", None]
    rows = spark.createDataFrame([(i, t, i != 1) for i, t in enumerate(texts)], "id int, translation_input_text string, is_final boolean")
    lossy = lambda: lambda row: {"text": row["text"].upper().replace("2018", "")}
    got = {r.id: (r.translation, r.translation_status) for r in boundary.translated(rows, lossy).collect()}
    assert set(got) == {i for i in range(len(texts)) if i != 1}
    for i, out in got.items():
        text = " ".join(" ".join(c.upper().replace("2018", "").split()) for c in align.translation_chunks(texts[i]))
        reason = "empty" if not text else anchor_reason(texts[i], text)
        assert out == ((None, reason) if reason else (text, "ok"))
    assert got[2][1] == "missing-numeric-anchor"


def test_inputs_and_results_of_the_edit_model():
    pieces = lambda words: ([len(w) for w in words for _ in range(len(w) % 3 + 1)], [i for i, w in enumerate(words) for _ in range(len(w) % 3 + 1)])
    inputs = align.model_inputs(["ab", "c", "defg"], pieces)
    assert inputs["offsets"] == [0, 1, 4, 6] and len(inputs["ids"]) == len(inputs["mask"]) == 8
    assert len(align.model_inputs(["a"] * 100, pieces)["offsets"]) == align.MAX_LENGTH + 1
    batch = [["a", "b"], ["a", "b"], ["a", "b"]]
    labels = [["$KEEP", "$KEEP", "$KEEP"], ["$KEEP", "$DELETE", "$KEEP"], ["$KEEP", "$DELETE", "$KEEP"]]
    assert align.postprocess_batch(batch, labels, [1.0, 0.2, 0.9], least_error=0.5) == [["a", "b"], ["a", "b"], ["b"]]


def test_two_models_of_one_kind_in_one_session(spark):
    """Workers are reused: the second model's results are its own."""
    rows = spark.createDataFrame([(i, 2000, bytes(64_000)) for i in range(3)], "id long, audio_ms long, pcm binary").coalesce(1)

    def model(value):
        return lambda: lambda row: {"v": [value]}

    for value in (1.0, 2.0, 1.0):
        assert [list(r.v) for r in boundary.embedded(rows, model(value)).collect()] == [[value]] * 3

    class Shout:
        mode = "x"

        def __init__(self, mark):
            self.mark = mark

        def process_text(self, text):
            return text.upper() + self.mark

    texts = spark.createDataFrame([("a",)], "t string")
    for mark in "!?":
        assert texts.select(boundary.postprocessed(F.col("t"), "x", lambda m=mark: Shout(m))).first()[0] == "A" + mark


def test_a_worker_keeps_few_instances_and_builds_each_once():
    built = []
    boundary._models.clear()
    for i in (1, 1, 2, 3, 4, 1, 5, 1, 2):
        boundary.single(f"k{i}", lambda i=i: built.append(i) or i)
    assert built == [1, 2, 3, 4, 5, 2] and len(boundary._models) == boundary.KEPT
    boundary._models.clear()
