"""Queries across model boundaries, with stand-ins that are labelled as such: no model is part of this repository."""

from __future__ import annotations

import tarfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import audio, boundary, hashing, numerals
from ..functions import text as T
from ..operators import align, intervals, lifecycle, vad
from ..registry import query
from ..sources import io
from .common import frames, micros, table

_CLEAN_SQL = r"trim(regexp_replace(coalesce(text, ''), '[\s\x00\x{00A0}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))"


def _stub_translator():
    """Stand-in for a translator: it gives the text back in capitals."""
    return lambda row: {"text": row["text"].upper()}


def _stub_recogniser():
    """Stand-in for a recogniser: it spells the samples' bytes."""
    return lambda row: {"text": bytes(row["pcm"]).hex(), "confidence": 1.0}


@query("S19_U7_translation_worker")
def translation_worker(spark, d):
    """All final turns in chunks through the translator's boundary; a test holds it against a plain version."""
    c = table(spark, d, "conversations")
    t = c.select("conv_id", "turn", F.col("text").alias("translation_input_text"), F.lit(True).alias("is_final"))
    return boundary.translated(t, _stub_translator).select("conv_id", "turn", "translation", "translation_status")


@query("A16_U5_transcription_requests", "SELECT item_id AS request_id, substring(lower(hex(encode(text))), 1, strlen(text) // 2 * 4) AS text, 'json' AS response_format, strlen(text) // 2 / 16000.0 AS duration FROM benchmark WHERE strlen(text) > 1")
def transcription_requests(spark, d):
    """Requests with WAV files, decoded and through the recogniser's boundary."""
    b = table(spark, d, "benchmark")
    r = io.requests(b.select(F.col("item_id").alias("request_id"), audio.to_wav(F.col("text").cast("binary")).alias("file")))
    p = r.select("request_id", "response_format", audio.decode_audio("file").alias("pcm"), F.lit("en").alias("language")).where(F.octet_length("pcm") > 0)
    out = boundary.recognised(p, _stub_recogniser)
    return out.select("request_id", "text", "response_format", (F.octet_length("pcm") / float(audio.BYTES_PER_SECOND)).alias("duration"))


@query("A1_A33_frames", "SELECT item_id AS client_id, CAST(ceil(strlen(text) // 2 * 2 / 640.0) AS BIGINT) AS n_frames, CAST(sum(strlen(text) // 2 * 2) AS BIGINT) AS n_bytes FROM benchmark GROUP BY item_id, text HAVING strlen(text) > 1")
def packet_frames(spark, d):
    """Packets of any size as frames of 640 bytes."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("client_id"), F.col("text").cast("binary").alias("data"))
    data = F.substring("data", F.lit(1), (F.floor(F.octet_length("data") / 2) * 2).cast("int"))
    packets = b.select("client_id", data.alias("data")).select("client_id", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("data") / 100).cast("int"))).alias("packet_no"), "data")
    packets = packets.select("client_id", "packet_no", F.current_timestamp().alias("ts"), F.substring("data", F.col("packet_no") * 100 + 1, F.lit(100)).alias("pcm"))
    return io.frames_of(packets).groupBy("client_id").agg(F.count("*").alias("n_frames"), F.sum(F.octet_length("pcm")).alias("n_bytes"))


@query("A9_A10_rejects", "SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value < 8 THEN 'too-short' END AS reason, count(*) AS n FROM events WHERE event_type = 'error' OR value < 8 GROUP BY ALL")
def rejects(spark, d):
    """What a filter turns away goes to a table of its own, by reason."""
    e = table(spark, d, "events")
    reason = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 8, "too-short")
    return e.select(reason.alias("reason"), "event_id").where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("B8_S26_storage_guard", "SELECT event_id, value * 1000 >= 64000 + 4096 AS ready FROM events")
def storage_guard(spark, d):
    """Room for a segment and the reserve."""
    return table(spark, d, "events").select("event_id", (F.col("value") * 1000 >= 64000 + 4096).alias("ready"))


def _vi_sql(n: str) -> str:
    """A number below 1000 in Vietnamese words."""
    digit = lambda x: f"(['một', 'hai', 'ba', 'bốn', 'năm', 'sáu', 'bảy', 'tám', 'chín'])[{x}]"
    tens = f"CASE WHEN {n} // 10 % 10 = 1 THEN 'mười' WHEN {n} // 10 % 10 > 1 THEN {digit(f'{n} // 10 % 10')} || ' mươi' WHEN {n} >= 100 AND {n} % 10 > 0 THEN 'linh' END"
    return f"CASE WHEN {n} = 0 THEN 'không' ELSE concat_ws(' ', CASE WHEN {n} >= 100 THEN {digit(f'{n} // 100')} || ' trăm' END, {tens}, CASE WHEN {n} % 10 > 0 THEN {digit(f'{n} % 10')} END) END"


@query("B20_display_dispatch", f"""
    WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS n FROM events)
    SELECT doc_id, {_CLEAN_SQL} AS display, {_CLEAN_SQL} AS translation_input FROM documents UNION ALL
    SELECT -1 - event_id, 'Khu ' || n || ' ở Việt Nam, nhưng có đẹp không?', 'Khu ' || {_vi_sql("n")} || ' ở Việt Nam, nhưng có đẹp không?' FROM e""")
def display_dispatch(spark, d):
    """Vietnamese texts (here sentences about the numbers of events) are shown and translated in their written forms, other languages in the canonical text."""
    said = F.concat_ws(" ", F.lit("khu"), numerals.vi_spelled(F.floor("value")), F.lit("ở việt nam nhưng có đẹp không"))
    phrases = table(spark, d, "events").select((-1 - F.col("event_id")).alias("doc_id"), said.alias("text"), F.lit("vi").alias("lang"))
    t = table(spark, d, "documents").select("doc_id", "text", "lang").unionByName(phrases)
    vi, other = t.where("lang = 'vi'"), t.where("lang <> 'vi' or lang is null")
    shown = vi.select("doc_id", numerals.written_form("text").alias("display"), numerals.translation_form("text").alias("translation_input"))
    return shown.unionByName(other.select("doc_id", T.clean_text("text").alias("display"), T.clean_text("text").alias("translation_input")))


@query("B30_capture_guard", "SELECT user_id, count(*) FILTER (event_type <> 'view' OR value >= 160) AS accepted, count(*) FILTER (event_type = 'view' AND value < 160) AS refused FROM events GROUP BY user_id")
def capture_guard(spark, d):
    """Captures of one kind need the native rate; what is refused is counted."""
    bad = (F.col("event_type") == "view") & (F.col("value") < 160)
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("refused"))


@query("C16_zip_join", "SELECT vec_id, unnest(range(0, len(embedding))) AS position, unnest(embedding) AS value FROM embeddings")
def zip_join(spark, d):
    """Arrays joined by position."""
    e = table(spark, d, "embeddings").where(F.size("embedding") > 0)
    z = e.select("vec_id", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("embedding") - 1).alias("i"), F.col("embedding").alias("v"))).alias("z"))
    return z.select("vec_id", F.col("z.i").cast("bigint").alias("position"), F.col("z.v").alias("value"))


def _packed(names, contents) -> bytes:
    """A tar archive, compressed: what a download would bring."""
    out = BytesIO()
    with tarfile.open(fileobj=out, mode="w:bz2") as archive:
        for name, content in zip(names, contents, strict=True):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, BytesIO(content))
    return out.getvalue()


@query("C18_A31_archive_members", """
    SELECT p_size AS archive, p_partkey AS member, CASE WHEN p_partkey % 6 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'corrupted' ELSE 'found' END AS state,
      CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 5 <> 0 THEN p_name END AS content FROM part""")
def archive_members(spark, d):
    """Wanted members of archives (parts, packed by size) with what they hold: found, missing or corrupted."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(group["p_size"].iloc[0])], "content": [_packed(group["name"], group["content"])]})

    p = table(spark, d, "part").select("p_size", F.col("p_partkey").cast("string").alias("name"), "p_name", F.col("p_partkey").alias("k"))
    content = F.when(F.col("k") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).cast("binary")
    files = p.where("k % 6 <> 0").select("p_size", "name", content.alias("content")).groupBy("p_size").applyInPandas(pack, "path string, content binary")
    wanted = p.select(F.col("p_size").cast("string").alias("archive"), F.col("name").alias("member"), hashing.sha256(F.col("p_name")).alias("sha256"))
    out = io.extracted(wanted, io.archive_members(files))
    return out.select(F.col("archive").cast("int").alias("archive"), F.col("member").cast("bigint").alias("member"), "state", F.col("content").cast("string").alias("content"))


@query("E9_segment_ids", "SELECT conv_id, turn, 'c' || conv_id || '-s' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS segment_id FROM conversations")
def segment_ids(spark, d):
    """Numbered ids of a turn's segments."""
    c = table(spark, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-s"), F.col("n").cast("string")).alias("segment_id"))


@query("S8_S31_S32_live_schedule", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type = 'purchase' AS is_final, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, t, n, is_final, CASE WHEN is_final THEN 'final' ELSE 'scheduled' END AS decision, CASE WHEN is_final THEN t + 9000000 ELSE -1 END AS busy, CASE WHEN is_final THEN -1 ELSE t END AS last, CASE WHEN is_final THEN -1 ELSE t + 6000000 END AS runs FROM e WHERE n = 1
      UNION ALL SELECT user_id, event_id, t, n, is_final, decision, CASE WHEN decision = 'final' THEN t + 9000000 ELSE busy END, CASE WHEN decision = 'scheduled' THEN t ELSE last END, CASE decision WHEN 'final' THEN -1 WHEN 'scheduled' THEN t + 6000000 ELSE runs END
      FROM (SELECT e.*, r.busy, r.last, r.runs, CASE WHEN e.is_final THEN 'final' WHEN e.t < r.busy THEN 'final-busy' WHEN r.runs >= 0 AND e.t < r.runs THEN 'preview-busy' WHEN r.last >= 0 AND e.t - r.last < 12000000 THEN 'interval' ELSE 'scheduled' END AS decision
            FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT user_id, event_id, CASE WHEN decision = 'scheduled' AND EXISTS (SELECT 1 FROM e f WHERE f.user_id = r.user_id AND f.is_final AND f.n > r.n AND f.t < r.t + 6000000) THEN 'cancelled' ELSE decision END AS decision FROM r""")
def live_schedule(spark, d):
    """Previews beside final work, in hours instead of seconds for the density of the test."""
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(micros("ts") / 1000).alias("ts_ms"), (F.col("event_type") == "purchase").alias("is_final"))
    return lifecycle.live_previews(e, "user_id", interval_ms=12_000_000, preview_ms=6_000_000, final_ms=9_000_000)


@query("S25_captures", """
    WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_type = 'purchase' AS leaves FROM events),
    f AS (SELECT *, CASE WHEN coalesce(lag(leaves) OVER w, TRUE) OR t - lag(t) OVER w > 36000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS capture_no FROM f),
    g AS (SELECT user_id, CAST(capture_no AS BIGINT) AS capture_no, min(t) AS joined_ms, max(t) AS left_ms, count(*) AS n_events, bool_or(leaves) AS l FROM c GROUP BY ALL)
    SELECT user_id, capture_no, joined_ms, left_ms, n_events, CASE WHEN l THEN 'disconnect' WHEN (SELECT max(t) FROM e) - left_ms > 36000000 OR lead(capture_no) OVER (PARTITION BY user_id ORDER BY capture_no) IS NOT NULL THEN 'timeout' ELSE 'open' END AS end_reason FROM g""")
def captures(spark, d):
    """Captures from joining to leaving, announced (a purchase) or by a silence of ten hours."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.floor(micros("ts") / 1000).alias("ts_ms"), (F.col("event_type") == "purchase").alias("gone"))
    return lifecycle.captures(e, "user_id", F.col("gone"), 36_000_000)


@query("S27_drained", """
    SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'service-stop-queued' ELSE 'service-stop-pending' END AS reason FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0""")
def drained(spark, d):
    """What a shutdown must keep of queued and pending work that isn't done."""
    e = table(spark, d, "events").where("event_type <> 'error'").select("event_id", "event_type")
    queued = e.where("event_type in ('click', 'purchase')")
    return lifecycle.drained(queued, e.where("event_id % 4 = 0"), e.where("event_type not in ('click', 'purchase')"), ["event_id"])


@query("S28_file_segments", """
    SELECT doc_id, 0.0::DOUBLE AS start_s, strlen(text) // 2 // 512 * 512 / 16000.0::DOUBLE AS end_s, CAST(strlen(text) // 2 // 512 * 1024 AS INTEGER) AS n_bytes FROM documents WHERE strlen(text) // 2 >= 512""")
def file_segments(spark, d):
    """Speech in whole files by an injected detector; the stand-in hears any sample but silence."""
    b = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    return vad.file_segments(b, "doc_id", _stub_detector).select("doc_id", "start_s", "end_s", F.octet_length("pcm").alias("n_bytes"))


def _stub_detector():
    """Stand-in for a voice detector."""
    return lambda samples: bool((samples != 0).any())


@query("S29_transport_buffer", """
    WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, CAST(floor(value) AS BIGINT) * 640 AS size FROM events),
    m AS (SELECT *, coalesce(lag(size) OVER w, 0) - coalesce((t - lag(t) OVER w) / 1e6 * 6.0, 0) AS move FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(move) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM m),
    b AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) + size AS held FROM s),
    o AS (SELECT *, bool_or(held > 900000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS refused FROM b)
    SELECT user_id, count(*) FILTER (NOT refused) AS sent, count(*) FILTER (refused) AS refused, min(event_id) FILTER (refused AND held > 900000) IS NOT NULL AS stopped FROM o GROUP BY user_id""")
def transport_buffer(spark, d):
    """A client's bounded buffer; the packet that it can't hold stops the capture, and nothing is lost unseen."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.floor("value") * 640).alias("size"))
    b = lifecycle.buffered(e, "user_id", ["ts", "event_id"], micros("ts"), rate=6.0, bound=900_000)
    return b.groupBy("user_id").agg(F.count_if(~F.col("refused")).alias("sent"), F.count_if("refused").alias("refused"), F.bool_or("stopped").alias("stopped"))


@query("S15_noise_learning")
def noise_learning(spark, d):
    """Segments of each capture, where long ones of little speech are rejected and raise the noise floor of what follows; a test holds it against a plain version."""
    f = frames(spark, d).withColumn("seq", F.col("event_id"))
    n = F.row_number().over(Window.partitionBy("client_id").orderBy("ts_us", "event_id"))
    f = f.select("client_id", (n * 20).cast("bigint").alias("ts_ms"), n.cast("bigint").alias("frame_no"), "rms", "peak", n.cast("bigint").alias("seq"))
    f = lifecycle.numbered_captures(f, "client_id", F.col("seq") % 500 == 0, 10_000)
    return vad.segments(f, ["client_id", "capture_no"], judge=_stub_judge)


def _stub_judge(segment: dict) -> str | None:
    """Stand-in for a recogniser that finds no words where there is little speech."""
    return "empty" if segment["speech_ratio"] < 0.6 else None


@query("S11_S34_final_order", "SELECT conv_id, turn, turn - coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) = 1 AS in_order, text <> coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS changed FROM conversations")
def final_order(spark, d):
    """Segments in order, and whether a row changes what was shown."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before, text = F.coalesce(F.lag("turn").over(w), F.lit(-1)), F.coalesce(F.lag("text").over(w), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") - before == 1).alias("in_order"), (F.col("text") != text).alias("changed"))


def _islands(table_: str, keys: str, name: str) -> str:
    """Common table expressions that end with ``name``: the unions of half-open ranges (s, e) of ``table_`` within ``keys``."""
    return f"""{name}_r AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {table_} WHERE e > s),
    {name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_r),
    {name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY {keys}, island)"""


@query("S17_diarised_regions", f"""
    WITH u AS (SELECT user_id % 3 AS room, user_id AS label, epoch_us(ts) // 1000 // 10 AS s, (epoch_us(ts) // 1000 + 600000) // 10 AS e FROM events), {_islands("u", "room, label", "own")},
    b AS (SELECT a.room, a.label, a.s AS bs, a.e AS be, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM own a JOIN own b ON a.room = b.room AND a.label <> b.label AND a.s < b.e AND b.s < a.e), {_islands("b", "room, label, bs, be", "m")},
    g AS (SELECT room, label, s - coalesce(lag(e) OVER (PARTITION BY room, label, bs, be ORDER BY s), bs) AS n FROM m UNION ALL SELECT room, label, be - max(e) FROM m GROUP BY room, label, bs, be
      UNION ALL SELECT room, label, e - s FROM own WHERE (room, label, s) NOT IN (SELECT (room, label, bs) FROM m)),
    t AS (SELECT room, label, CAST(sum(n) AS BIGINT) AS clean_samples FROM g WHERE n >= 35 GROUP BY room, label)
    SELECT room, label, clean_samples FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY clean_samples DESC, label) AS place FROM t) WHERE place = 1""")
def diarised_regions(spark, d):
    """Clean ranges of each local speaker, and the one with most of them."""
    from .common import utterances

    u = utterances(spark, d).select("room", F.col("client_id").alias("label"), F.floor(F.col("started_ms") / 10).alias("start"), F.floor(F.col("ended_ms") / 10).alias("end"))
    own = intervals.merged(u, ["room", "label"])
    clean = intervals.uncontested(own, ["room"], 35)
    sums = clean.groupBy("room", "label").agg(F.sum(F.col("end") - F.col("start")).alias("clean_samples"))
    w = Window.partitionBy("room").orderBy(F.desc("clean_samples"), "label")
    return sums.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def _stub_editor(tokens: list[str]) -> tuple[list[str], float]:
    """Stand-in for the text-edit model: a capital first, a full stop last."""
    if tokens and tokens[0][:1].islower():
        return ["$KEEP", "$TRANSFORM_CASE_CAPITAL", *["$KEEP"] * (len(tokens) - 1)], 1.0
    if tokens and tokens[-1] != ".":
        return ["$KEEP", *["$KEEP"] * (len(tokens) - 1), "$APPEND_."], 1.0
    return ["$KEEP"] * (len(tokens) + 1), 1.0


@query("H37_H43_U10_edit_loop")
def edit_loop(spark, d):
    """Texts through chunks, edits and merging, with a stand-in for the model."""
    edit = numerals.as_column(lambda t: align.edit_document((t or "").lower(), _stub_editor))
    return table(spark, d, "conversations").select("conv_id", "turn", edit("text").alias("edited"))


@query("H59_speaker_json", """SELECT vec_id, '{"label":' || label || ',"score":"' || printf('%.4f', embedding[1]) || '"}' AS body FROM embeddings""")
def speaker_json(spark, d):
    """JSON with fixed decimals."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.to_json(F.struct("label", F.format_string("%.4f", F.get("embedding", F.lit(0)).cast("double")).alias("score"))).alias("body"))


@query("H60_first_difference", """
    WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    n AS (SELECT *, coalesce(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[i] <> y[i])[1] - 1, least(length(x), length(y))) AS n FROM p)
    SELECT conv_id, turn, n || ':' || substring(x, CAST(n + 1 AS BIGINT), 12) || '|' || substring(y, CAST(n + 1 AS BIGINT), 12) AS first_diff FROM n""")
def first_difference(spark, d):
    """Where a turn and the next one first differ, and how alike they are."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", T.first_difference(F.col("text"), F.col("next")).alias("first_diff"))


@query("H72_beam_modes", "SELECT event_id, CASE WHEN event_type IN ('beam2', 'qa', 'retry', '2') THEN 2 ELSE 1 END AS beam FROM events")
def beam_modes(spark, d):
    """Beams by mode."""
    return table(spark, d, "events").select("event_id", boundary.beam(F.col("event_type")).alias("beam"))


@query("U1_U2_postprocess_modes", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS lower_text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS kept_text, text AS raw_text FROM benchmark")
def postprocess_modes(spark, d):
    """The three ways to finish a text."""
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", boundary.postprocessed(t, "clean_lower").alias("lower_text"), boundary.postprocessed(t, "normalize").alias("kept_text"), boundary.postprocessed(t, "none").alias("raw_text"))
