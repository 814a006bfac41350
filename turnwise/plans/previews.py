"""Queries on previews that are shown, jobs that are admitted, and the status of rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import previews
from ..registry import query
from .common import micros, table


def _stub_recogniser():
    """Stand-in for a recogniser: audio that is its own text, answered as a line."""
    return lambda row: {"reply": f"OK\t{row['language']}\t" + bytes(row["pcm"]).decode("utf-8", "replace").replace("\t", " ")}


def preview_requests(spark, d):
    """Turns of conversations as lanes of requests: a turn's first half, three quarters, and the whole of it twice, then its final work."""
    w = F.split(F.col("text"), " ")
    part = lambda share: F.array_join(F.slice(w, F.lit(1), F.ceil(F.size(w) * share).cast("int")), " ")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.array(part(0.5), part(0.75), F.col("text"), F.col("text"), F.lit(""))).alias("i", "said"))
    return c.select(
        F.col("conv_id").alias("lane"), (F.col("turn") * 8000 + F.col("i") * 1300).cast("long").alias("ts_ms"), (F.col("turn") * 10 + F.col("i")).cast("long").alias("event_id"), (F.col("i") == 4).alias("is_final"),
        F.col("conv_id").alias("client_id"), F.col("turn").alias("turn_id"), F.col("turn").alias("utterance_id"), F.col("said").cast("binary").alias("pcm"), F.lit("en").alias("language"),
    )


@query("S32_S9_published_previews")
def published_previews(spark, d):
    """Previews scheduled beside final work, decoded, judged, confirmed and shown; a test holds it against a plain version."""
    out = previews.published(preview_requests(spark, d), "lane", _stub_recogniser)
    return out.select("client_id", "turn_id", "event_id", F.length("text").alias("n_chars"))


@query("S22_admitted_jobs", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 11 AS job, CASE event_type WHEN 'view' THEN 'take' WHEN 'error' THEN 'done' ELSE 'queue' END AS kind, value > 10 AS is_final, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS waiting, CAST([] AS BIGINT[]) AS active, CAST(NULL AS BIGINT) AS job, CAST(NULL AS VARCHAR) AS status FROM e
      UNION ALL SELECT n.user_id, n.i, n.event_id, CASE status WHEN 'queued' THEN list_append(waiting, n.job) WHEN 'taken' THEN waiting[2:] ELSE waiting END,
        CASE status WHEN 'taken' THEN list_append(active, waiting[1]) WHEN 'done' THEN list_filter(active, lambda x: x <> n.job) ELSE active END, CASE status WHEN 'taken' THEN waiting[1] ELSE n.job END, status
      FROM (SELECT e.*, s.waiting, s.active, CASE kind WHEN 'queue' THEN CASE WHEN NOT is_final THEN 'not-final' WHEN list_contains(s.waiting, e.job) OR list_contains(s.active, e.job) THEN 'coalesced' WHEN len(s.waiting) >= 4 THEN 'queue-full' ELSE 'queued' END
          WHEN 'take' THEN CASE WHEN len(s.waiting) > 0 THEN 'taken' END ELSE CASE WHEN list_contains(s.active, e.job) THEN 'done' END END AS status
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) n)
    SELECT user_id, event_id, job, status FROM s WHERE status IS NOT NULL""")
def admitted_jobs(spark, d):
    """Jobs of final turns in queues of four a client: queued, coalesced, refused, taken and done."""
    kind = F.when(F.col("event_type") == "view", "take").when(F.col("event_type") == "error", "done").otherwise("queue")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 11).alias("job"), kind.alias("kind"), (F.col("value") > 10).alias("is_final"))
    return previews.admitted(e, "user_id", ["ts", "event_id"], capacity=4).select("user_id", "event_id", "job", "status")


@query("S33_room_status", """
    WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_id % 5 END AS room, event_type AS state FROM events),
    m AS (SELECT *, lead(at_ms) OVER w AS until_ms, lead(seq) OVER w AS until_seq, lag(room) OVER w AS old FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, seq)),
    c AS (SELECT DISTINCT r AS room, at_ms, seq FROM m, unnest([room, old]) t(r) WHERE r IS NOT NULL)
    SELECT c.room, c.at_ms, c.seq, count(m.seq) AS participants, count(m.seq) FILTER (m.state = 'click') AS n_click, count(m.seq) FILTER (m.state = 'view') AS n_view
    FROM c LEFT JOIN m ON m.room = c.room AND (m.at_ms, m.seq) <= (c.at_ms, c.seq) AND (m.until_ms IS NULL OR (c.at_ms, c.seq) < (m.until_ms, m.until_seq)) GROUP BY ALL""")
def room_status(spark, d):
    """Participants of each room and what they do, after every change."""
    e = table(spark, d, "events")
    c = e.select("user_id", F.floor(micros("ts") / 1000).alias("at_ms"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("event_id") % 5).alias("room"), F.col("event_type").alias("state"))
    return previews.room_status(c, "user_id", "at_ms", "seq", ["click", "view"], block_ms=36_000_000)
