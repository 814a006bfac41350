"""Queries on sessions, run lengths, numbering, sliding frames (families D, E, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sessions, vad
from ..registry import query
from .common import FRAMES_SQL, frames, micros, table

SIX_HOURS = 21_600_000_000


@query(
    "turn_sessions",
    f"""
    WITH f AS (SELECT user_id, event_id, ts, value,
                      CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {SIX_HOURS} THEN 0 ELSE 1 END AS is_new
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         g AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM f)
    SELECT user_id, CAST(turn_no AS BIGINT) AS turn_no, min(ts) AS started_at, max(ts) AS ended_at,
           count(*) AS segment_count, max(value) AS peak
    FROM g GROUP BY user_id, turn_no""",
)
def turn_sessions(spark, d):
    """Gap sessions of each client, rolled up."""
    e = table(spark, d, "events")
    s = sessions.gap_sessions(e, ["user_id"], micros("ts"), ["ts", "event_id"], SIX_HOURS)
    return s.groupBy("user_id", "turn_no").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("segment_count"), F.max("value").alias("peak"))


@query(
    "B2_D2_speech_like_stats",
    f"""
    WITH f AS ({FRAMES_SQL}), g AS (SELECT *, rms >= greatest(0.006, 0.003 * 2.4) AND peak >= greatest(0.012, greatest(0.006, 0.003 * 2.4) * 1.45) AS speech_like FROM f)
    SELECT client_id, count(*) AS frames, avg(rms) AS avg_rms, max(peak) AS peak_rms,
           least(1.0, greatest(0.0, avg(CAST(speech_like AS INTEGER)))) AS speech_ratio FROM g GROUP BY client_id""",
)
def speech_like_stats(spark, d):
    """The speech predicate, and levels of each client."""
    f = frames(spark, d).withColumn("like", vad.speech_like(F.col("rms"), F.col("peak"), F.lit(0.003)))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(F.col("like").cast("int"))))
    return f.groupBy("client_id").agg(F.count("*").alias("frames"), F.avg("rms").alias("avg_rms"), F.max("peak").alias("peak_rms"), ratio.alias("speech_ratio"))


_RUNS = f"""
    WITH f AS ({FRAMES_SQL}), g AS (SELECT *, CASE WHEN rms >= 0.0072 THEN 1 ELSE 0 END AS on_ FROM f),
    h AS (SELECT *, sum(1 - on_) OVER (PARTITION BY client_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS a,
                    sum(on_) OVER (PARTITION BY client_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS b FROM g),
    r AS (SELECT *, CAST(sum(on_) OVER (PARTITION BY client_id, a ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS speech_run,
                    CAST(sum(1 - on_) OVER (PARTITION BY client_id, b ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS silence_run FROM h)"""


@query("E1_E2_run_lengths", _RUNS + "SELECT client_id, event_id, speech_run, silence_run, speech_run = 4 AS onset, silence_run = 3 AS ended FROM r")
def run_lengths(spark, d):
    """How many frames of speech, and of silence, in a row."""
    f = frames(spark, d)
    f = sessions.run_length(f, ["client_id"], ["ts_us", "event_id"], F.col("rms") >= 0.0072, "speech_run")
    f = sessions.run_length(f, ["client_id"], ["ts_us", "event_id"], F.col("rms") < 0.0072, "silence_run")
    return f.select("client_id", "event_id", "speech_run", "silence_run", (F.col("speech_run") == 4).alias("onset"), (F.col("silence_run") == 3).alias("ended"))


@query(
    "E3_preroll",
    f"""WITH f AS ({FRAMES_SQL}) SELECT client_id, event_id, len(l) AS preroll_frames, list_max(l) AS preroll_peak, l[1] AS oldest FROM
        (SELECT client_id, event_id, list(rms) OVER (PARTITION BY client_id ORDER BY ts_us, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM f)""",
)
def preroll(spark, d):
    """The last 30 frames with each frame."""
    f = sessions.preroll(frames(spark, d), ["client_id"], ["ts_us", "event_id"], "rms")
    return f.select("client_id", "event_id", F.size("preroll").cast("bigint").alias("preroll_frames"), F.array_max("preroll").alias("preroll_peak"), F.get("preroll", F.lit(0)).alias("oldest"))


@query(
    "E4_noise_floor",
    f"""WITH f AS ({FRAMES_SQL}), l AS (SELECT client_id, list(rms ORDER BY ts_us, event_id) AS l FROM f GROUP BY client_id)
        SELECT client_id, round(list_reduce(list_concat([0.003::DOUBLE], l), lambda n, x: CASE WHEN x < greatest(0.006, n * 2.4) THEN greatest(0.001, n * 0.985 + x * 0.015) ELSE n END), 9) AS noise_floor FROM l""",
)
def noise_floor(spark, d):
    """The recursive mean of idle levels."""
    floors = vad.noise_floors(frames(spark, d), "client_id", ["ts_us", "event_id"])
    return floors.select("client_id", F.round("noise_floor", 9).alias("noise_floor"))


@query(
    "E10_E11_last_wins",
    """SELECT user_id, count(*) AS revision, max_by(event_type, ts_key) AS event_type, max_by(value, ts_key) AS value
       FROM (SELECT *, (epoch_us(ts), event_id) AS ts_key FROM events) GROUP BY user_id""",
)
def last_wins(spark, d):
    """The newest row of each id and how often it changed."""
    e = table(spark, d, "events").withColumn("seq", F.struct(micros("ts"), "event_id"))
    new = sessions.latest(e.select("user_id", "seq", "event_type", "value"), ["user_id"], "seq")
    return new.join(e.groupBy("user_id").agg(F.count("*").alias("revision")), "user_id").select("user_id", "revision", "event_type", "value")


@query(
    "E11_merge_last_non_null",
    """SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) FILTER (event_type = 'purchase') AS last_purchase,
              max_by(props, event_id) FILTER (event_type = 'click') AS last_click_props FROM events GROUP BY user_id""",
)
def merge_last(spark, d):
    """A later row laid over an earlier one, column by column."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"), F.when(F.col("event_type") == "click", F.col("props")).alias("last_click_props"))
    return sessions.merged_latest(e, ["user_id"], "event_id")


@query(
    "E12_F1_first_seen_order",
    """WITH f AS (SELECT user_id, min(event_id) AS first_seq FROM events GROUP BY user_id)
       SELECT user_id, first_seq, row_number() OVER (ORDER BY first_seq, user_id) AS ordinal FROM f""",
)
def first_seen(spark, d):
    """Keys in the order of their first appearance."""
    return sessions.first_seen(table(spark, d, "events"), "user_id", "event_id")


@query(
    "E16_left_context",
    """WITH s AS (SELECT conv_id, turn, length(text) * 20 AS novel FROM conversations)
       SELECT conv_id, turn, novel, CAST(least(coalesce(sum(novel) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
              10000, greatest(0, 24000 - novel)) AS BIGINT) AS context_prefix FROM s""",
)
def left_context(spark, d):
    """Bounded audio before each segment of a turn."""
    s = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") * 20).cast("bigint").alias("novel"))
    return sessions.left_context(s, ["conv_id"], ["turn"], "novel")


@query(
    "E17_live_windows",
    """WITH w AS (SELECT user_id, value, s FROM events, unnest(generate_series(epoch_us(ts) // 3600000000 - 4, epoch_us(ts) // 3600000000)) AS t(s))
       SELECT user_id, CAST(s * 3600000000 AS BIGINT) AS window_start_us, count(*) AS n, max(value) AS peak FROM w GROUP BY user_id, s""",
)
def live_windows(spark, d):
    """Windows of five hours that begin every hour."""
    e = table(spark, d, "events").select("user_id", "value", F.window(F.col("ts").cast("timestamp"), "5 hours", "1 hour").alias("w"))
    return e.groupBy("user_id", F.unix_micros("w.start").alias("window_start_us")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))


_HOUR = 3_600_000_000


@query("E17_anchored_windows", f"""
    WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events),
    f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {24 * _HOUR} THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS turn_no FROM f),
    s AS (SELECT user_id, turn_no, min(t) AS a, max(t) AS b FROM g GROUP BY ALL),
    w AS (SELECT user_id, turn_no, k AS window_no, a, least(b, a + k * {3 * _HOUR}) AS till FROM s, unnest(generate_series(1, greatest(1, CAST(ceil((b - a) / {3 * _HOUR}.0) AS BIGINT)))) r(k))
    SELECT user_id, CAST(turn_no AS BIGINT) AS turn_no, CAST(window_no AS BIGINT) AS window_no, count(*) AS n, max(value) AS peak FROM w JOIN g USING (user_id, turn_no)
    WHERE t <= till AND (t > till - {8 * _HOUR} OR t = a AND t >= till - {8 * _HOUR}) GROUP BY ALL""")
def anchored_windows(spark, d):
    """Of each segment (a day's pause ends it) the last eight hours every three hours from its start, the last window as short as is left."""
    at = micros("ts")
    turns = sessions.gap_sessions(table(spark, d, "events"), ["user_id"], at, ["ts", "event_id"], 24 * _HOUR)
    seen = sessions.live_windows(turns, ["user_id", "turn_no"], at, 3 * _HOUR, 8 * _HOUR)
    return seen.groupBy("user_id", "turn_no", "window_no").agg(F.count("*").alias("n"), F.max("value").alias("peak"))


@query(
    "E18_newer_revisions",
    """SELECT user_id, event_id, revision FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS revision,
          max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
       WHERE m IS NULL OR revision > m""",
)
def newer_revisions(spark, d):
    """Previews that are newer than all before."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.floor("value").alias("revision"))
    return sessions.newer_only(e, ["user_id"], ["ts", "event_id"], "revision").select("user_id", "event_id", "revision")


@query(
    "E13_best_second_margin",
    """WITH r AS (SELECT user_id, event_type, max(value) AS score FROM events GROUP BY ALL),
            p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS place FROM r),
            b AS (SELECT user_id, max(event_type) FILTER (place = 1) AS best_id, max(score) FILTER (place = 1) AS best, coalesce(max(score) FILTER (place = 2), -1) AS second FROM p WHERE place <= 2 GROUP BY user_id)
       SELECT *, CASE WHEN second < -0.5 THEN 1.0 ELSE best - second END AS margin FROM b""",
)
def best_second(spark, d):
    """Best and second with the margin between them."""
    r = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("score"))
    p = r.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_type"))).where("place <= 2")
    at = lambda c, n: F.max(F.when(F.col("place") == n, F.col(c)))
    b = p.groupBy("user_id").agg(at("event_type", 1).alias("best_id"), at("score", 1).alias("best"), F.coalesce(at("score", 2), F.lit(-1.0)).alias("second"))
    return b.withColumn("margin", F.when(F.col("second") < -0.5, 1.0).otherwise(F.col("best") - F.col("second")))


@query(
    "E14_word_starts",
    """WITH w AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
       SELECT conv_id, turn, role FROM w WHERE before IS NULL OR before <> role""",
)
def word_starts(spark, d):
    """Positions where the id changes."""
    c = table(spark, d, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where(F.col("before").isNull() | (F.col("before") != F.col("role"))).select("conv_id", "turn", "role")


@query(
    "F4_F5_newest_rows",
    """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""",
)
def newest_rows(spark, d):
    """The newest rows of each room."""
    return sessions.top_per_key(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role", "text")


@query("F4_history_limit", "SELECT conv_id, turn, role FROM (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 500)")
def history_limit(spark, d):
    """The last 500 rows by sequence; the limit is the feature."""
    return table(spark, d, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).limit(500).select("conv_id", "turn", "role")


@query("F9_gate_seed", "SELECT user_id % 3 AS room, min_by(event_id, (epoch_us(ts), event_id)) AS seed FROM events GROUP BY ALL")
def gate_seed(spark, d):
    """the earliest of those that are ready."""
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 3).alias("room")).agg(F.min_by("event_id", F.struct(micros("ts"), "event_id")).alias("seed"))


@query(
    "F10_group_dominant",
    "SELECT user_id, max_by(event_id, (value, -event_id)) AS dominant FROM events GROUP BY user_id",
)
def group_dominant(spark, d):
    """the loudest, the first of equals."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("dominant"))


@query("F13_pick_file", "SELECT p_type, min_by(p_name, (CASE WHEN p_name LIKE '%1' THEN 0 ELSE 1 END, p_name)) AS picked FROM part GROUP BY p_type")
def pick_file(spark, d):
    """exact names first, else the least by name."""
    return table(spark, d, "part").groupBy("p_type").agg(F.min_by("p_name", F.struct(F.when(F.col("p_name").endswith("1"), 0).otherwise(1), "p_name")).alias("picked"))


@query(
    "F14_prefix_by_share",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto,
          sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE upto <= total * 0.5""",
)
def prefix_by_share(spark, d):
    """rows while the running length is within half of the total."""
    w = Window.partitionBy("conv_id")
    c = table(spark, d, "conversations").withColumn("upto", F.sum(F.length("text")).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    return c.withColumn("total", F.sum(F.length("text")).over(w)).where("upto <= total * 0.5").select("conv_id", "turn")


@query(
    "F15_groups_by_start",
    "SELECT user_id, min(ts) AS started_at, row_number() OVER (ORDER BY min(ts), user_id) AS place FROM events GROUP BY user_id",
)
def groups_by_start(spark, d):
    """groups in the order of their earliest start."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("started_at"))
    return sessions.ranked(g, micros("started_at"), ["started_at", "user_id"], "place")


@query("S1_S3_vad_segments")
def vad_segments(spark, d):
    """The voice-activity fold over each client's frames, 20 ms apart in order of event."""
    f = frames(spark, d)
    n = F.row_number().over(Window.partitionBy("client_id").orderBy("ts_us", "event_id"))
    return vad.segments(f.select("client_id", (n * 20).cast("bigint").alias("ts_ms"), n.cast("bigint").alias("frame_no"), "rms", "peak"))
