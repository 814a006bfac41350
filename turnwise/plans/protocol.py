"""Queries on control messages, names, headers, bodies and files, run through ``functions/wire.py`` and ``operators/protocol.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wire
from ..operators import protocol
from ..registry import query
from .common import micros, table


def _pick(n, *choices):
    """The ``n``-th of some columns or texts."""
    return F.element_at(F.array(*[c if not isinstance(c, str) else F.lit(c) for c in choices]), (n + 1).cast("int"))


_MESSAGES = (
    '{"type":"join","name":" Ann ","room":"r/%s"}', '{"type":"join","name":null}', '{"type":"language_pref","language":" EN "}', '{"type":"capture_start"}',
    '{"type":"capture_start","language":"auto"}', '{"type":"capture_stop"}', '{"type":"speech_start","utterance_id":"-u %s-","started_ms":0}', '{"type":"speech_end"}',
    '{"type":"ping","client_ts":%s}', '{"type":', '{"type":"dance"}', '{"type":"speech_end","language":"en"}',
)


@query("A2_A34_control_sessions", """
    WITH RECURSIVE m AS (SELECT user_id, event_id, (event_id * 7 + user_id) % 12 AS n, event_id % 13 = 0 AS refused, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i,
        epoch_us(ts) // 1000 AS ms FROM events),
    v AS (SELECT *, ['join', 'join', 'language_pref', 'capture_start', 'capture_start', 'capture_stop', 'speech_start', 'speech_end', 'ping', NULL, NULL, 'speech_end'][n + 1] AS verb FROM m),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS VARCHAR) AS verb, '' AS before, 'off' AS state, CAST(NULL AS VARCHAR) AS reply, 'default' AS room, 'Guest' AS name, 'vi' AS language, 'off' AS mic FROM m
      UNION ALL
      SELECT v.user_id, v.i, v.event_id, v.ms, v.verb, s.state,
        CASE WHEN verb_ = 'capture_stop' OR verb_ = 'speech_end' AND s.state = 'speech' THEN 'off' WHEN verb_ = 'capture_start' AND s.state = 'off' AND NOT refused THEN 'capture'
          WHEN verb_ = 'speech_start' AND s.state = 'off' AND NOT refused THEN 'speech' ELSE s.state END,
        CASE verb_ WHEN 'join' THEN CASE s.state WHEN 'off' THEN 'joined' ELSE 'join-during-capture' END
          WHEN 'capture_start' THEN CASE s.state WHEN 'capture' THEN 'already-active' WHEN 'speech' THEN 'capture-mode-conflict' ELSE CASE WHEN refused THEN 'storage-pressure' ELSE 'capture_ready' END END
          WHEN 'speech_start' THEN CASE WHEN s.state <> 'off' THEN 'speech-already-active' WHEN refused THEN 'storage-pressure' END WHEN 'ping' THEN 'pong' END,
        CASE WHEN verb_ = 'join' AND s.state = 'off' THEN CASE n WHEN 0 THEN 'r-' || v.event_id ELSE 'default' END ELSE s.room END,
        CASE WHEN verb_ = 'join' AND s.state = 'off' THEN CASE n WHEN 0 THEN 'Ann' ELSE 'Guest' END ELSE s.name END,
        CASE WHEN verb_ = 'join' AND s.state = 'off' OR n = 4 AND (s.state = 'capture' OR s.state = 'off' AND NOT refused) THEN 'vi' WHEN verb_ = 'language_pref' THEN 'en' ELSE s.language END,
        CASE WHEN verb_ = 'capture_stop' OR verb_ = 'join' AND s.state = 'off' THEN 'off' WHEN verb_ = 'capture_start' AND s.state = 'off' AND NOT refused OR verb_ = 'speech_end' AND s.state = 'speech' THEN 'listening'
          WHEN verb_ = 'speech_start' AND s.state = 'off' AND NOT refused THEN 'speaking' ELSE s.mic END
      FROM s JOIN (SELECT *, coalesce(verb, '') AS verb_ FROM v) v ON v.user_id = s.user_id AND v.i = s.i + 1)
    SELECT event_id, verb, before, state, reply, room AS current_room, name AS current_name, language AS current_language, mic, CASE WHEN verb = 'speech_start' THEN 'u-' || event_id END AS utterance_id,
      CASE WHEN verb = 'speech_start' THEN ms END AS started_ms, CASE WHEN verb = 'ping' THEN CAST(event_id AS DOUBLE) END AS client_ts FROM s WHERE i > 0""")
def control_sessions(spark, d):
    """Control messages read by schema, each client's session state, the replies, and what is in force."""
    text = F.format_string
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(micros("ts") / 1000).alias("at_ms"), ((F.col("event_id") * 7 + F.col("user_id")) % 12).alias("n"))
    raw = _pick(F.col("n"), *[text(m, F.col("event_id").cast("string")) if "%s" in m else m for m in _MESSAGES])
    rows = e.select("user_id", "event_id", "at_ms", raw.alias("message"), F.when(F.col("event_id") % 13 == 0, "storage-pressure").alias("refusal"))
    out = protocol.sessions(rows, "user_id", ["at_ms", "event_id"], refusal="refusal")
    return out.select("event_id", "verb", "before", "state", "reply", "current_room", "current_name", "current_language", "mic", "utterance_id", "started_ms", "client_ts")


@query("A3_request_lines", """
    SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'wav' WHEN 4 THEN NULL ELSE 'pcm' END AS mode, CASE WHEN doc_id % 5 < 4 THEN '/spool/' || doc_id END AS path,
      CASE WHEN doc_id % 5 < 3 THEN lower(trim(coalesce(lang, ''))) WHEN doc_id % 5 = 3 THEN 'vi' END AS language,
      CASE WHEN doc_id % 5 IN (0, 2) THEN trim(coalesce(source, '')) WHEN doc_id % 5 < 4 THEN '' END AS client_id, CASE WHEN doc_id % 5 = 4 THEN 'bad-request' END AS error FROM documents""")
def request_lines(spark, d):
    """A3: lines of today, older ones and broken ones, read as requests."""
    path, lang, client = F.concat(F.lit("/spool/"), F.col("doc_id").cast("string")), F.concat(F.lit(" "), F.upper(F.coalesce("lang", F.lit(""))), F.lit(" ")), F.coalesce("source", F.lit(""))
    line = lambda *parts: F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = _pick(F.col("doc_id") % 5, line("PCM", path, lang, client), line("WAV", path, lang), line(path, lang, client), path, line("PCM", path))
    return table(spark, d, "documents").select("doc_id", wire.request_line(raw).alias("r")).select("doc_id", "r.*")


@query("B19_reply_records", r"""
    WITH r AS (SELECT doc_id, doc_id % 7 AS n, lower(trim(coalesce(lang, ''))) AS lang, trim(regexp_replace(coalesce(text, ''), '[\s\x00]+', ' ', 'g')) AS body FROM (SELECT doc_id, lang, replace(text, chr(9), ' ') AS text FROM documents))
    SELECT doc_id, n IN (2, 4) AND body <> '' AS ok, CASE WHEN n IN (2, 3, 4) THEN lang ELSE '' END AS language, CASE WHEN n IN (2, 4) THEN md5(body) ELSE md5('') END AS digest,
      CASE n WHEN 0 THEN 'quiet' WHEN 1 THEN 'worker-error' WHEN 3 THEN 'empty' WHEN 5 THEN 'invalid-reply' WHEN 6 THEN 'invalid-reply' ELSE CASE WHEN body = '' THEN 'empty' END END AS reason, CASE n WHEN 2 THEN 'greedy' END AS decode_mode FROM r""")
def reply_records(spark, d):
    """Replies with whole texts, errors, silence, older records and broken ones."""
    t = table(spark, d, "documents").select("doc_id", F.upper(F.coalesce("lang", F.lit(""))).alias("lang"), F.coalesce(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("")).alias("text"))
    line = lambda *parts: F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) and p in ("OK", "Greedy", "") else p for p in parts])
    raw = _pick(F.col("doc_id") % 7, "SKIP\tquiet", "ERR\t", line("OK", "lang", "text", "Greedy"), line("OK", "lang", ""), line("lang", "text"), line("OK", "lang"), "nothing")
    r = t.select("doc_id", wire.recogniser_reply(raw).alias("r"))
    return r.select("doc_id", "r.ok", "r.language", F.md5(F.col("r.text").cast("binary")).alias("digest"), "r.reason", "r.decode_mode")


@query("A17_response_bodies", r"""
    WITH c AS (SELECT *, length(text) / 8.0::DOUBLE AS duration FROM conversations),
    j AS (SELECT *, to_json({'task': 'transcribe', 'language': 'vi', 'duration': duration, 'text': text,
        'segments': list_transform(string_split(text, chr(10)), lambda s, i: {'id': 'segment_' || (i - 1), 'type': 'transcript.text.segment', 'start': CAST((i - 1) * 1.5 AS DOUBLE), 'end': CAST((i - 1) * 1.5 + 1.25 AS DOUBLE), 'text': s}),
        'usage': {'type': 'duration', 'seconds': CAST(round(duration) AS BIGINT)}})::VARCHAR AS long FROM c)
    SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(long, '\/', '/') ELSE '{"text":' || replace(to_json(text)::VARCHAR, '\/', '/') || '}' END AS body FROM j""")
def response_bodies(spark, d):
    """Bodies with numbered segments (a turn's lines) and whole seconds."""
    lines = F.transform(F.split("text", "\n", -1), lambda s, i: F.struct((i * 1.5).alias("start"), (i * 1.5 + 1.25).alias("end"), s.alias("text")))
    kind = _pick(F.col("conv_id") % 3, "text", "verbose_json", "json")
    return table(spark, d, "conversations").select("conv_id", "turn", wire.response_body(kind, F.col("text"), F.lit("vi"), F.length("text") / 8.0, lines).alias("body"))


_ORIGIN = "^([a-z]+://[^/:?#]+)"


@query("B12_origin_rules", f"""
    WITH o AS (SELECT page_id, regexp_extract(url, '{_ORIGIN}', 1) AS o FROM pages), h AS (SELECT *, lower(regexp_extract(o, '://(.+)$', 1)) AS host FROM o)
    SELECT page_id, coalesce(o, '') = '' OR o LIKE 'https:%' AND ends_with(host, '.example.org') OR host IN ('localhost', '127.0.0.1') OR o = 'https://m.example.net' OR page_id % 10 = 0 AS allowed FROM h""")
def origin_rules(spark, d):
    """Origins by list, suffix over https, local host and the server's own."""
    o = F.regexp_extract("url", _ORIGIN, 1)
    sent = F.when(F.col("page_id") % 4 == 0, F.concat(o, F.lit("/"))).otherwise(o)
    p = table(spark, d, "pages").select("page_id", F.when(o == "", "").otherwise(sent).alias("o"), F.when(F.col("page_id") % 10 == 0, o).otherwise("http://own.test").alias("own"))
    return p.select("page_id", wire.origin_allowed("o", ["https://m.example.net"], [".example.org"], local=True, own=F.col("own")).alias("allowed"))


@query("B13_protocol_names", r"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '/(en|de|fr|vi)/', 1) AS l FROM pages)
    SELECT page_id, regexp_replace(coalesce(nullif(u[1:64], ''), 'default'), '[^A-Za-z0-9._-]', '-', 'g') AS room, coalesce(nullif(u[1:64], ''), 'Guest') AS name, CASE WHEN l = 'en' THEN 'en' ELSE 'vi' END AS pref,
      coalesce(nullif(regexp_replace(regexp_replace(u[1:80], '[^A-Za-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g')[1:64], ''), 'page-' || page_id) AS utterance FROM p""")
def protocol_names(spark, d):
    """Rooms, names, languages and ids of utterances, made safe."""
    said = F.upper(F.regexp_extract(F.coalesce("url", F.lit("")), "/(en|de|fr|vi)/", 1))
    fallback = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", wire.room_name("url").alias("room"), wire.guest_name("url").alias("name"), wire.language_pref(said).alias("pref"), wire.utterance_name("url", fallback).alias("utterance"))


@query("B14_shown_state", """
    SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'corrected' WHEN event_id % 3 = 0 OR value > 250 THEN CASE WHEN event_type IN ('error', 'view') THEN 'uncertain' ELSE 'verified' END
      WHEN event_id % 3 = 1 THEN 'uncertain' ELSE 'provisional' END AS state FROM events""")
def shown_state(spark, d):
    """What a client shows of a segment, by its check, its stability and whether it is final."""
    kinds = {"error": "right-context-unresolved", "purchase": "corrected-right-context-2", "view": "uncertain-overlap"}
    status = F.when(F.lit(False), "")
    for kind, text in kinds.items():
        status = status.when(F.col("event_type") == kind, text)
    stability = _pick(F.col("event_id") % 3, "verified", "uncertain", "live")
    return table(spark, d, "events").select("event_id", wire.segment_state(status, stability, F.col("value") > 250).alias("state"))


_FAILURES = (
    ("model is required", "model_required"), ("multipart field 'file' is required", "file_required"), ("audio duration exceeds %s seconds", "audio_too_long"), ("unknown model id: m%s", "model_not_found"),
    ("ffmpeg not found on PATH", "ffmpeg_not_found"), ("failed to launch ffmpeg: %s", "ffmpeg_launch_failed"), ("hound error %s", "audio_decode_failed"), ("CAPU runtime unavailable: down", "capu_unavailable"),
    ("CAPU request timed out: %s ms", "capu_timeout"), ("CAPU request failed: %s", "capu_failed"), ("failed to parse multipart %s", "invalid_multipart"), ("inference failed", "inference_failed"),
    ("request body exceeds max_upload_mb = %s now", "request_too_large"), ("disk %s on fire", "internal_error"),
)


@query("H57_B16_localised_errors", f"""
    WITH e AS (SELECT event_id, CAST(event_id % {len(_FAILURES)} AS INTEGER) AS n FROM events)
    SELECT event_id, [{', '.join(repr(code) for _, code in _FAILURES)}][n + 1] AS code, CASE n WHEN 2 THEN 'Thời lượng âm thanh vượt quá giới hạn ' || event_id || ' giây.' WHEN 3 THEN 'Không tìm thấy model với mã ID: m' || event_id || '.'
        WHEN 8 THEN 'Yêu cầu hậu kỳ CAPU đã hết thời gian chờ: ' || event_id || ' ms.' WHEN 13 THEN 'Lỗi máy chủ nội bộ: disk ' || event_id || ' on fire.' ELSE '' END AS told,
      CASE WHEN n IN (4, 5) THEN 500 ELSE 400 END AS decode_status, CASE WHEN n = 8 THEN 504 ELSE 500 END AS run_status, CASE WHEN n = 12 THEN event_id END AS max_mb FROM e""")
def localised_errors(spark, d):
    """Codes, local texts, status classes and limits of messages."""
    n = F.col("event_id") % len(_FAILURES)
    m = _pick(n, *[F.format_string(t, F.col("event_id").cast("string")) if "%s" in t else t for t, _ in _FAILURES])
    e = table(spark, d, "events").select("event_id", n.alias("n"), m.alias("m")).withColumn("x", wire.localised_error("m", F.lit(True)))
    told = F.when(F.col("n").isin(2, 3, 8, 13), F.col("x.message")).otherwise("")
    return e.select("event_id", "x.code", told.alias("told"), wire.decode_error("m")["status"].alias("decode_status"), wire.runtime_error("m")["status"].alias("run_status"), wire.upload_limit("m").alias("max_mb"))


@query("B17_weighted_languages", """
    WITH e AS (SELECT event_id, event_id % 7 AS n, event_id % 10 AS q FROM events)
    SELECT event_id, CASE n WHEN 0 THEN q >= 5 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false ELSE q >= 2 END AS prefers_vi FROM e""")
def weighted_languages(spark, d):
    """Lists of languages with weights, without, broken and empty."""
    q = (F.col("event_id") % 10).cast("string")
    header = _pick(F.col("event_id") % 7, F.concat(F.lit("vi;q=0."), q, F.lit(", en-US;q=0.5")), "en", "vi-VN, en;q=0.9", "fr, de;q=0.2", "EN;q=0.7,VI;q=bad", "", F.concat(F.lit("en;q=.2, vi;q=0."), q, F.lit(",vi;q=0.1")))
    return table(spark, d, "events").select("event_id", wire.prefers(header).alias("prefers_vi"))


@query("E14_piece_starts", """
    WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word, unnest(range(1, len(list_filter(string_split(text, ' '), lambda x: x <> '')) + 1)) AS i FROM conversations),
    p AS (SELECT *, 1 + coalesce(sum((length(word) + 3) // 4) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM w)
    SELECT conv_id, turn, '0,' || string_agg(CAST(place AS BIGINT), ',' ORDER BY i) || ',' || CAST(max(place + (length(word) + 3) // 4) AS BIGINT) AS starts FROM p GROUP BY conv_id, turn""")
def piece_starts(spark, d):
    """Where words begin among pieces of four characters, with a mark of no word at both ends."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    pieces = F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.floor((F.length(w) + 3) / 4).cast("int"))))
    mark = F.array(F.lit(None).cast("int"))
    starts = wire.word_starts(F.concat(mark, pieces, mark))
    return table(spark, d, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.array_join(F.transform(starts, lambda x: x.cast("string")), ",").alias("starts"))


_FILE = "CASE p_size % 3 WHEN 0 THEN '.bin' WHEN 1 THEN '.txt' ELSE '.onnx' END"


@query("F13_asset_files", f"""
    WITH f AS (SELECT p_brand AS folder, replace(p_name, ' ', '-') || {_FILE} AS name FROM part),
    p AS (SELECT *, CASE WHEN name = 'red-widget.bin' THEN 0 WHEN name = 'small-ring.onnx' THEN 1 WHEN name LIKE 'small-%.bin' OR name LIKE 'r%.txt' THEN 2 END AS place FROM f)
    SELECT folder, min_by(name, (place, name)) FILTER (place IS NOT NULL) AS picked FROM p GROUP BY folder""")
def asset_files(spark, d):
    """a model's file in each folder, by exact names, then by patterns."""
    f = table(spark, d, "part").select(F.col("p_brand").alias("folder"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.expr(_FILE)).alias("name"))
    return protocol.picked(f, "folder", "name", ["red-widget.bin", "small-ring.onnx"], [("small-", ".bin"), ("r", ".txt")])


@query("H59_speakers_body", """
    SELECT vec_id, printf('{"engine":"seg-reid-v1","diarized_speakers":2,"dominant":"SPEAKER_%02d","regions":[{"start":%.3f,"end":%.3f,"local":0,"speaker_id":"SPEAKER_%02d"},{"start":%.3f,"end":%.3f,"local":1,"speaker_id":"UNKNOWN"}],"locals":[{"local":0,"clean_ms":%d,"speaker_id":"SPEAKER_%02d","score":%.4f,"match":"seg-known","raw_best":%.4f,"raw_second":%.4f,"raw_margin":%.4f},{"local":1,"clean_ms":0,"speaker_id":"UNKNOWN"}]}',
      vec_id % 7, (vec_id % 50) / 100, (vec_id % 50) / 100 + 2, vec_id % 7, (vec_id % 50) / 100 + 2, (vec_id % 50) / 100 + 2.5, 2000 + vec_id % 100, vec_id % 7, (vec_id % 97) / 100, (vec_id % 97) / 100, (vec_id % 31) / 100, (vec_id % 97 - vec_id % 31) / 100) AS body FROM embeddings""")
def speakers_body(spark, d):
    """Regions and voices of a clip as JSON with fixed decimals, known speakers and unknown ones."""
    v = F.col("vec_id")
    begin = (v % 50) * 160
    who = F.format_string("SPEAKER_%02d", v % 7)
    score, second = (v % 97) / F.lit(100.0), (v % 31) / F.lit(100.0)
    region = lambda label, a, b: F.struct(a.alias("start"), b.alias("end"), F.lit(label).alias("label"))
    none = F.lit(None)
    local = lambda label, clean, *x: F.struct(F.lit(label).alias("label"), clean.cast("bigint").alias("clean_samples"), *[c.cast(k).alias(n) for c, k, n in zip(x, ["string", "string", *["double"] * 4], ["speaker_id", "match", "score", "raw_best", "raw_second", "raw_margin"], strict=True)])
    known = local(0, (v % 100 + 2000) * 16, who, F.lit("seg-known"), score, score, second, (v % 97 - v % 31) / F.lit(100.0))
    body = wire.speakers_body(F.lit(2), who, F.array(region(0, begin, begin + 32_000), region(1, begin + 32_000, begin + 40_000)), F.array(known, local(1, F.lit(15), *[none] * 6)))
    return table(spark, d, "embeddings").select("vec_id", body.alias("body"))


@query("H60_difference_summary", """
    WITH p AS (SELECT conv_id, turn, text, instr(text, ',') - 1 AS k, length(text) AS n FROM conversations WHERE instr(text, ',') > 0)
    SELECT conv_id, turn, 'delete' AS tag, k || '-' || (k + 1) || '|' || k || '-' || k AS spans, substring(text, greatest(k - 90, 0) + 1, k + 91 - greatest(k - 90, 0)) AS left_context, 2.0 * (n - 1) / (2 * n - 1) AS similarity, true AS normalized_equal
    FROM p""")
def difference_summary(spark, d):
    """Where a turn and the same turn without its first comma part, how alike they are, and that their words are equal."""
    c = table(spark, d, "conversations").where("instr(text, ',') > 0")
    other = F.concat(F.substring_index("text", ",", 1), F.expr("substring(text, instr(text, ',') + 1)"))
    x = c.select("conv_id", "turn", protocol.difference(F.col("text"), other).alias("x"))
    pair = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "-")
    return x.select("conv_id", "turn", "x.tag", F.concat(pair("x.left_span"), F.lit("|"), pair("x.right_span")).alias("spans"), "x.left_context", "x.similarity", "x.normalized_equal")
