"""Queries of the read side: rooms, history, exports, wire messages (families A, B, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import sha256
from ..operators import turns
from ..registry import query
from ..sources import io
from .common import micros, table

_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x00]+', ' ', 'g'))"


@query("A17_format_response", """
    SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN text
      WHEN 1 THEN '{"task":"transcribe","language":"en","duration":' || length(text) || ',"segments":[{"id":"segment_0","text":' || replace(to_json(text)::VARCHAR, '\\/', '/') || '}]}'
      ELSE '{"text":' || replace(to_json(text)::VARCHAR, '\\/', '/') || '}' END AS body FROM conversations""")
def format_response(spark, d):
    """Text, verbose JSON or JSON, by the format asked for."""
    c = table(spark, d, "conversations")
    part = F.array(F.struct(F.lit("segment_0").alias("id"), "text"))
    verbose = F.to_json(F.struct(F.lit("transcribe").alias("task"), F.lit("en").alias("language"), F.length("text").alias("duration"), part.alias("segments")))
    body = F.when(F.col("conv_id") % 3 == 0, F.col("text")).when(F.col("conv_id") % 3 == 1, verbose).otherwise(F.to_json(F.struct("text")))
    return c.select("conv_id", "turn", body.alias("body"))


@query("A19_D16_export_text", f"""
    SELECT conv_id, string_agg('[' || strftime(to_timestamp(1700000000 + conv_id * 1000 + turn * 10) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || '] ' || role || ' (' || upper('en') || '): ' || {_CLEAN.format('text')}, chr(10) ORDER BY turn) AS body
    FROM conversations GROUP BY conv_id""")
def export_text(spark, d):
    """Lines with time, speaker and language, in order."""
    c = table(spark, d, "conversations")
    at = F.date_format(F.timestamp_seconds(1700000000 + F.col("conv_id") * 1000 + F.col("turn") * 10), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(F.lit("["), at, F.lit("] "), "role", F.lit(" ("), F.upper(F.lit("en")), F.lit("): "), T.clean_text("text"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


@query("A20_export_sections", """
    SELECT conv_id, section, CASE section WHEN 1 THEN 'TRANSCRIPT' WHEN 2 THEN 'SPEAKER TURNS' WHEN 3 THEN 'TRANSLATION' ELSE 'DIAGNOSTICS' END AS title, count(*) AS n_lines,
      CAST(sum(length(CASE section WHEN 1 THEN text WHEN 2 THEN role || ': ' || text WHEN 3 THEN text ELSE 'turn ' || turn || ' chars ' || length(text) END)) AS BIGINT) AS n_chars
    FROM conversations, unnest([1, 2, 3, 4]) t(section) WHERE section <> 3 OR role = 'assistant' GROUP BY conv_id, section""")
def export_sections(spark, d):
    """Four projections under one another, in the order of sections."""
    c = table(spark, d, "conversations")
    parts = [
        (1, "TRANSCRIPT", c, F.col("text")), (2, "SPEAKER TURNS", c, F.concat("role", F.lit(": "), "text")),
        (3, "TRANSLATION", c.where(F.col("role") == "assistant"), F.col("text")),
        (4, "DIAGNOSTICS", c, F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" chars "), F.length("text").cast("string"))),
    ]
    rows = None
    for section, title, source, line in parts:
        one = source.select("conv_id", F.lit(section).alias("section"), F.lit(title).alias("title"), line.alias("line"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("conv_id", "section", "title").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("A21_B1_D6_room_info", """
    SELECT conv_id AS room, count(DISTINCT role) AS participants, count(*) AS turns, count(*) FILTER (role = 'user') AS pending, count(*) FILTER (length(text) > 200) AS long_turns
    FROM conversations GROUP BY conv_id""")
def room_info(spark, d):
    """Participants and counts of each room."""
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("room")).agg(
        F.count_distinct("role").alias("participants"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("pending"), F.count_if(F.length("text") > 200).alias("long_turns"))


@query("A22_B21_health", """
    SELECT count(*) AS rows_total, count(DISTINCT user_id) AS clients, count(DISTINCT user_id % 3) AS rooms, max(value) AS peak, count(*) FILTER (event_type = 'error') AS errors,
      count(*) FILTER (event_type = 'error') < count(*) AND count(DISTINCT user_id) > 0 AS ready FROM events""")
def health(spark, d):
    """One wide row of gauges and whether the system is ready."""
    e = table(spark, d, "events")
    row = e.agg(F.count("*").alias("rows_total"), F.count_distinct("user_id").alias("clients"), F.count_distinct(F.col("user_id") % 3).alias("rooms"), F.max("value").alias("peak"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return row.withColumn("ready", (F.col("errors") < F.col("rows_total")) & (F.col("clients") > 0))


#: Keys that a room's events are dealt over, and the ids that a block of its clients is taken from (some 256 of a room).
_DEALT, _BLOCK = 96, 768


@query("A23_C15_room_fanout", "SELECT e.event_id, c.user_id AS client_id FROM events e JOIN (SELECT DISTINCT user_id, user_id % 3 AS room FROM events) c ON e.user_id % 3 = c.room WHERE e.event_type = 'error' AND c.user_id <> e.user_id")
def fanout(spark, d):
    """Each event to all other clients of its room.

    A room's events are dealt over ``_DEALT`` keys, each of which has all clients of the room. What comes out is far larger
    than what is joined, so the number of tasks is fixed, not found by the size of what they read. Clients come in blocks, one
    block after another to all events of a key: the same few clients follow each other again and again, so that files stay small.
    """
    e = table(spark, d, "events")
    room = (F.col("user_id") % 3).alias("room")
    block = F.expr(f"user_id div {_BLOCK}").alias("block")
    clients = e.select("user_id").distinct().groupBy(room, block).agg(F.sort_array(F.collect_list("user_id")).alias("clients"))
    clients = clients.select("room", "clients", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))).alias("part"))
    part = F.pmod(F.xxhash64("event_id"), F.lit(_DEALT)).cast("int")
    sent = e.where(F.col("event_type") == "error").select("event_id", "user_id", room, part.alias("part"))
    dealt = [x.repartition(_DEALT, "room", "part") for x in (clients, sent)]
    met = dealt[0].join(dealt[1].hint("merge"), ["room", "part"]).select("event_id", "user_id", F.explode("clients").alias("client_id"))
    return met.where("client_id <> user_id").select("event_id", "client_id")


@query("A2_A34_wire_messages", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def wire_messages(spark, d):
    """JSON messages read by a schema and dispatched by type."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("A3_line_protocol", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'PCM' ELSE 'WAV' END AS kind, '/spool/' || doc_id AS path, lang, source AS client FROM documents""")
def line_protocol(spark, d):
    """A3: tab-separated requests taken apart."""
    t = table(spark, d, "documents")
    line = F.concat_ws("\t", F.when(F.col("doc_id") % 2 == 0, "PCM").otherwise("WAV"), F.concat(F.lit("/spool/"), F.col("doc_id").cast("string")), "lang", "source")
    f = F.split(line, "\t")
    return t.select("doc_id", f[0].alias("kind"), f[1].alias("path"), f[2].alias("lang"), f[3].alias("client"))


@query("A28_G1_case_list", """
    SELECT 'golden' AS origin, CAST(item_id AS VARCHAR) AS label, length(text) AS chars FROM benchmark UNION ALL
    SELECT 'report' AS origin, 'c' || conv_id || '/' || ['30s', '2m', '4m', 'full'][turn % 4 + 1] AS label, length(text) AS chars FROM conversations WHERE turn % 4 < 3""")
def case_list(spark, d):
    """The cases of a list and those of nested reports (one a conversation, as JSON), whose labels must end in a length."""
    a = table(spark, d, "benchmark").select(F.lit("golden").alias("origin"), F.col("item_id").cast("string").alias("label"), F.length("text").cast("bigint").alias("chars"))
    ends = F.element_at(F.array(*map(F.lit, ("30s", "2m", "4m", "full"))), (F.col("turn") % 4 + 1).cast("int"))
    label = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), ends)
    case = F.struct(label.alias("label"), F.length("text").alias("char_count"), "text")
    reports = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(case).alias("cases"))
    lines = reports.select(F.to_json(F.struct(F.array(F.struct(F.col("conv_id").cast("string").alias("asset"), "cases")).alias("assets"))).alias("line"))
    cases = io.cases_of(lines.select(F.from_json("line", io.REPORT).alias("r")).select("r.assets"))
    return a.unionByName(cases.select(F.lit("report").alias("origin"), "label", F.col("char_count").cast("bigint").alias("chars")))


@query("A32_report_rows", "SELECT '| ' || lang || ' | ' || count(*) || ' | ' || max(n_chars) || ' |' AS line FROM documents GROUP BY lang")
def report_rows(spark, d):
    """A markdown table of results."""
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("m"))
    return g.select(F.concat(F.lit("| "), F.concat_ws(" | ", "lang", F.col("n").cast("string"), F.col("m").cast("string")), F.lit(" |")).alias("line"))


@query("B12_origin_allowed", """
    WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
    SELECT page_id, host, ends_with(host, '.example.org') OR host IN ('localhost', '127.0.0.1') OR host = 'therea.example.net' AS allowed FROM h""")
def origin_allowed(spark, d):
    """Allowed by suffix, local host or list."""
    h = F.parse_url("url", F.lit("HOST"))
    return table(spark, d, "pages").select("page_id", h.alias("host"), (h.endswith(".example.org") | h.isin("localhost", "127.0.0.1") | (h == "therea.example.net")).alias("allowed"))


@query("B13_safe_names", """
    SELECT page_id, CASE WHEN s = '' THEN 'main' ELSE s END AS room FROM (SELECT page_id, regexp_replace(substring(trim(url), 1, 64), '[^A-Za-z0-9_.-]+', '-', 'g') AS s FROM pages)""")
def safe_names(spark, d):
    """Names cut, cleaned and defaulted."""
    return table(spark, d, "pages").select("page_id", T.safe_name("url", "main").alias("room"))


@query("B14_segment_state", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN props LIKE '%7%' AND value > 250 THEN 'corrected' WHEN event_type = 'purchase' THEN 'final' WHEN value < 50 THEN 'preview' ELSE 'verifying' END AS state FROM events""")
def segment_state(spark, d):
    """Five states by status text and flags."""
    s = F.when(F.col("event_type") == "error", "rejected").when(F.col("props").contains("7") & (F.col("value") > 250), "corrected").when(F.col("event_type") == "purchase", "final").when(F.col("value") < 50, "preview").otherwise("verifying")
    return table(spark, d, "events").select("event_id", s.alias("state"))


@query("B15_valid_key", r"SELECT page_id, regexp_full_match(url, '[\x21-\x7e]{1,255}') AS valid FROM pages")
def valid_key(spark, d):
    """1 to 255 visible ASCII characters."""
    return table(spark, d, "pages").select("page_id", F.col("url").rlike(r"^[\x21-\x7e]{1,255}$").alias("valid"))


@query("B18_C14_resolved_models", """
    SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, 'default') AS brand, coalesce(s.s_name, (SELECT s_name FROM supplier ORDER BY s_suppkey LIMIT 1)) AS supplier
    FROM part LEFT JOIN supplier s ON p_partkey = s.s_suppkey""")
def resolved_models(spark, d):
    """Values of the model, else of the configuration; unknown ids get the first entry."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    first = s.agg(F.min_by("s_name", "s_suppkey").alias("first_name"))
    found = p.join(s, p["p_partkey"] == s["s_suppkey"], "left")
    return found.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("default")).alias("brand"), F.coalesce(F.col("s_name"), first.scalar()).alias("supplier"))


@query("B19_recogniser_reply", """
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'SKIP' WHEN doc_id % 4 = 1 THEN 'ERR' ELSE 'OK' END AS status, CASE WHEN doc_id % 4 > 1 THEN lang ELSE '' END AS language,
      CASE WHEN doc_id % 4 > 1 THEN source ELSE '' END AS body FROM documents""")
def recogniser_reply(spark, d):
    """Replies of the recogniser taken apart."""
    t = table(spark, d, "documents")
    reply = F.when(F.col("doc_id") % 4 == 0, "SKIP\tquiet").when(F.col("doc_id") % 4 == 1, "ERR\tdown").otherwise(F.concat_ws("\t", F.lit("OK"), "lang", "source"))
    f = F.split(reply, "\t", 3)
    ok = f[0] == "OK"
    return t.select("doc_id", f[0].alias("status"), F.when(ok, F.get(f, F.lit(1))).otherwise("").alias("language"), F.when(ok, F.get(f, F.lit(2))).otherwise("").alias("body"))


#: Turns of conversations and segments of them: every third turn isn't there yet.
_TURN_SQL = "SELECT conv_id % 3 AS room, conv_id AS client_id, turn // 2 AS turn_id, turn AS segment_index, length(text) AS size FROM conversations"


def _turn_segments(spark, d):
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") % 3).alias("room"), F.col("conv_id").alias("client_id"), F.floor(F.col("turn") / 2).alias("turn_id"), F.col("turn").alias("segment_index"), F.length("text").alias("size"))


@query("C4_turn_lookup", f"""
    WITH s AS ({_TURN_SQL}), t AS (SELECT client_id, turn_id, sum(size) AS turn_size FROM s GROUP BY ALL HAVING (client_id + turn_id) % 3 <> 0)
    SELECT s.client_id, s.turn_id, s.segment_index, CAST(t.turn_size AS BIGINT) AS turn_size, t.turn_size IS NULL AS is_new FROM s LEFT JOIN t USING (client_id, turn_id)""")
def turn_lookup(spark, d):
    """C4: a segment's turn by client and turn id, also where there is none yet."""
    s = _turn_segments(spark, d)
    t = s.groupBy("client_id", "turn_id").agg(F.sum("size").alias("turn_size")).where((F.col("client_id") + F.col("turn_id")) % 3 != 0)
    return turns.looked_up(s, t, ["client_id", "turn_id"]).select("client_id", "turn_id", "segment_index", "turn_size", "is_new")


@query("C11_G7_pruned_turns", f"""
    WITH s AS ({_TURN_SQL}), state AS (SELECT DISTINCT client_id, turn_id FROM s)
    SELECT client_id, turn_id FROM state WHERE (client_id, turn_id) NOT IN (SELECT (client_id, turn_id) FROM s WHERE segment_index >= 4)
      AND (client_id, turn_id) NOT IN (SELECT (client_id, turn_id) FROM s WHERE size > 400) AND (client_id, turn_id) NOT IN (SELECT (client_id, turn_id) FROM s WHERE room = 0 AND segment_index = 0)""")
def pruned_turns(spark, d):
    """State of turns that are neither in the history, nor pending, nor active."""
    s = _turn_segments(spark, d)
    state = s.select("client_id", "turn_id").distinct()
    return turns.to_prune(state, s.where("segment_index >= 4"), s.where("size > 400"), s.where("room = 0 and segment_index = 0"))


#: Parts as locked assets with the hash that their file should have; some files are gone, some have changed.
_ASSET_SQL = """SELECT p_partkey AS id, 'm/' || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'corrupted' ELSE 'valid' END AS kind,
    CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 = 0 THEN sha256(p_name || '!') END AS actual_sha256 FROM part"""


def _assets(spark, d):
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("m/"), F.col("p_partkey").cast("string")))
    lock = p.select(F.col("p_partkey").alias("id"), "path", sha256(F.col("p_name")).alias("sha256"))
    content = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return lock, p.where("p_partkey % 7 <> 0").select("path", content.cast("binary").alias("content"))


@query("C19_B24_asset_status", _ASSET_SQL)
def asset_status(spark, d):
    """Each locked asset with its file: missing, valid, or corrupted with the hash that was found."""
    return io.asset_status(*_assets(spark, d)).select("id", "path", "status.kind", "status.actual_sha256")


@query("C9_G3_missing_assets", f"SELECT id FROM ({_ASSET_SQL}) WHERE kind <> 'valid'")
def missing_assets(spark, d):
    """Assets that a model can't start without: those that are not there as locked."""
    lock, files = _assets(spark, d)
    valid = io.asset_status(lock, files).where("status.kind = 'valid'").select("id")
    return lock.join(valid, "id", "left_anti").select("id")


@query("C10_D25_verification", f"SELECT kind, count(*) AS n, bool_or(kind <> 'valid') AS needs_download FROM ({_ASSET_SQL}) GROUP BY kind")
def verification(spark, d):
    """Entries of the lock by the state that their report has; what has no report needs a download."""
    lock, files = _assets(spark, d)
    report = io.asset_status(lock, files).where("status.kind <> 'missing'").select("id", "status")
    kind = F.coalesce("status.kind", F.lit("missing"))
    return lock.join(report, "id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.bool_or(kind != "valid").alias("needs_download"))


@query("C12_turn_segments", f"SELECT client_id, turn_id, string_agg(CAST(segment_index AS VARCHAR), ',' ORDER BY segment_index) AS segments FROM ({_TURN_SQL}) GROUP BY ALL")
def turn_segments(spark, d):
    """A turn's segments in order."""
    return turns.gathered(_turn_segments(spark, d), ["client_id", "turn_id"], "segment_index").select("client_id", "turn_id", F.array_join(F.transform("segments", lambda s: s["segment_index"].cast("string")), ",").alias("segments"))


@query("C17_not_stale", """
    SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, turn, (length(text) % 3) AS source_revision, text FROM conversations) t
      ON c.conv_id = t.conv_id AND c.turn = t.turn AND t.source_revision = 1""")
def not_stale(spark, d):
    """C17: results of the revision and text that the turn still has."""
    c = table(spark, d, "conversations")
    now = c.select("conv_id", "turn", (F.length("text") % 3).alias("source_revision"), F.col("text").alias("translation_input_text"))
    results = c.select("conv_id", "turn", F.lit(1).alias("source_revision"), F.col("text").alias("translation_source_text"))
    return turns.not_stale(results, now, ["conv_id", "turn"]).select("conv_id", "turn")


@query("D3_turn_rollup", """
    SELECT conv_id, CAST(sum(length(text) * 60) AS BIGINT) AS audio_ms, count(*) AS segment_count, min(turn * 1000) AS started_ms, max(turn * 1000 + length(text) * 60) AS ended_ms, count(*) AS revision, max(turn) AS last_segment_index
    FROM conversations GROUP BY conv_id""")
def turn_rollup(spark, d):
    """Segments of a turn summed up."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("segment_index"), (F.length("text") * 60).alias("audio_ms"), (F.col("turn") * 1000).alias("started_ms"), (F.col("turn") * 1000 + F.length("text") * 60).alias("ended_ms"))
    return turns.rolled_up(c, ["conv_id"])


@query("D4_D5_dominant_speaker", """
    WITH s AS (SELECT conv_id, role AS speaker_id, CAST(sum(greatest(1, length(text) * 60)) AS BIGINT) AS spoken_ms, min(turn) AS first_index FROM conversations GROUP BY ALL)
    SELECT conv_id, speaker_id, spoken_ms, first_index FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY spoken_ms DESC, first_index, speaker_id) AS n FROM s) WHERE n = 1""")
def dominant_speaker(spark, d):
    """Who spoke most."""
    c = table(spark, d, "conversations").select("conv_id", F.col("role").alias("speaker_id"), (F.length("text") * 60).alias("audio_ms"), F.col("turn").alias("segment_index"))
    return turns.dominant_speaker(c, ["conv_id"])


@query("D16_H70_turn_text", f"""
    SELECT conv_id, regexp_replace(string_agg({_CLEAN.format('text')}, ' ' ORDER BY turn) FILTER ({_CLEAN.format('text')} <> ''), '\\s+([,.;:!?%])', '\\1', 'g') AS turn_text FROM conversations GROUP BY conv_id""")
def turn_text(spark, d):
    """Texts of a turn in order, no space before punctuation."""
    return turns.assembled(table(spark, d, "conversations"), ["conv_id"], "text", "turn")


@query("F3_segment_replace", """
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN turn = 0 THEN 1000 ELSE length(text) END) AS BIGINT) AS total FROM conversations GROUP BY conv_id HAVING bool_or(turn = 0)""")
def segment_replace(spark, d):
    """One segment of an array replaced by its index, the array sorted."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("segment_index"), F.length("text").cast("bigint").alias("size"))
    a = c.groupBy("conv_id").agg(F.collect_list(F.struct("segment_index", "size")).alias("s")).where(F.exists("s", lambda x: x["segment_index"] == 0))
    new = F.struct(F.lit(0).cast("bigint").alias("segment_index"), F.lit(1000).cast("bigint").alias("size"))
    s = turns.with_segment(F.col("s"), new)
    return a.select("conv_id", F.size(s).cast("bigint").alias("n"), F.aggregate(s, F.lit(0).cast("bigint"), lambda t, x: t + x["size"]).alias("total"))


@query("S13_S12_turn_log")
def turn_log(spark, d):
    """Every revision of every turn."""
    c = table(spark, d, "conversations")
    h = c.select((F.col("conv_id") % 3).cast("string").alias("room"), F.col("conv_id").cast("string").alias("client_id"), F.col("conv_id").cast("string").alias("turn_id"), F.col("turn").cast("int").alias("segment_index"),
                 (F.col("turn") * 1000).alias("started_ms"), (F.col("turn") * 1000 + 900).alias("ended_ms"), F.lit(900).cast("bigint").alias("audio_ms"), "text")
    return turns.turn_log(h)


@query("S14_finalised", "SELECT user_id, max(epoch_us(ts)) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 3600000 AS is_final FROM events GROUP BY user_id")
def finalised(spark, d):
    """Turns whose gap has passed."""
    e = table(spark, d, "events")
    now = e.agg(F.floor(F.max(micros("ts")) / 1000).alias("now"))
    t = e.groupBy("user_id").agg(F.floor(F.max(micros("ts")) / 1000).alias("ended_ms")).withColumn("now", now.scalar())
    t = t.withColumns({"pending_segments": F.lit(0), "is_final": F.lit(False)})
    return turns.finalised(t, F.col("now"), 3_600_000).select("user_id", "is_final")
