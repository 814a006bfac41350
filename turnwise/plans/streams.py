"""Queries that run streams over a table to its end, and the batch forms of the same operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, idempotency
from ..registry import query
from ..sources import spool
from ..streaming import joins, late, processors, run, upsert
from .common import UTTERANCES_SQL, micros, table, utterances

#: A hold of ten minutes and windows a hundred times wider than the product's, for the density of the test.
LIMITS = gate.Limits(hold_ms=600_000, capacity=6, start_delta_ms=65_000, end_delta_ms=90_000)
#: Delay of the watermark of streams over events.
DELAY_MS = 3_600_000


def _gate_sql(where: str) -> str:
    """The gate as a machine in a recursive query: each step either lets the oldest group out or takes the next capture in."""
    fits = f"""(x.client_id <> y.client_id AND abs(x.started_ms - y.started_ms) <= {LIMITS.start_delta_ms} AND abs(x.ended_ms - y.ended_ms) <= {LIMITS.end_delta_ms}
        AND greatest(0, least(x.ended_ms, y.ended_ms) - greatest(x.started_ms, y.started_ms)) / least(greatest(1, x.ended_ms - x.started_ms), greatest(1, y.ended_ms - y.started_ms)) >= {LIMITS.overlap})"""
    near = lambda a, b: fits.replace("x.", f"{a}.").replace("y.", f"{b}.")
    return f"""
    WITH RECURSIVE u AS ({UTTERANCES_SQL}),
    a AS (SELECT room, row_number() OVER (PARTITION BY room ORDER BY ended_ms, utterance_id) AS n,
          {{'utterance_id': utterance_id, 'client_id': client_id, 'received_ms': ended_ms, 'started_ms': started_ms, 'ended_ms': ended_ms, 'rms': avg_rms, 'peak': peak_rms}} AS c FROM u),
    s AS (SELECT room, 1::BIGINT AS i, list_filter([any_value(c)], lambda x: false) AS pending, list_filter([any_value(c)], lambda x: false) AS gone, false AS bypassed FROM a GROUP BY room
      UNION ALL
      SELECT s.room, CASE WHEN f THEN i ELSE i + 1 END,
        CASE WHEN f THEN list_filter(pending[2:], lambda x: NOT {near("pending[1]", "x")}) WHEN len(pending) >= {LIMITS.capacity} THEN pending ELSE list_append(pending, a.c) END,
        CASE WHEN f THEN list_prepend(pending[1], list_filter(pending[2:], lambda x: {near("pending[1]", "x")})) WHEN len(pending) >= {LIMITS.capacity} THEN [a.c] ELSE [] END,
        NOT f AND len(pending) >= {LIMITS.capacity}
      FROM (SELECT s.*, len(pending) > 0 AND (a.c IS NULL OR pending[1].received_ms + {LIMITS.hold_ms} < a.c.received_ms) AS f FROM s LEFT JOIN a ON a.room = s.room AND a.n = s.i) s
      LEFT JOIN a ON a.room = s.room AND a.n = s.i WHERE f OR a.c IS NOT NULL),
    g AS (SELECT room, gone, bypassed, gone[1] AS seed, list_sort(list_transform(gone, lambda x: {{'rms': -x.rms, 'peak': -x.peak, 'received_ms': x.received_ms, 'utterance_id': x.utterance_id}}))[1].utterance_id AS loudest FROM s WHERE len(gone) > 0),
    o AS (SELECT room, seed, bypassed, loudest, list_filter(gone, lambda x: x.utterance_id = loudest)[1] AS loud, unnest(gone) AS x FROM g)
    SELECT room, seed.utterance_id AS group_id, x.utterance_id AS utterance_id, x.utterance_id = loudest AS is_dominant,
      x.utterance_id <> loudest AND {near("loud", "x")} AND loud.rms > 0 AND x.rms > 0 AND loud.rms / greatest(x.rms, 1e-9) >= {LIMITS.rms_ratio} AND loud.peak / greatest(x.peak, 1e-9) >= {LIMITS.peak_ratio} AS echo_suspected,
      bypassed, CASE WHEN bypassed THEN x.received_ms ELSE seed.received_ms + {LIMITS.hold_ms} END AS forwarded_ms
    FROM o {where}"""


def _received(spark, d):
    return utterances(spark, d).withColumn("received_ms", F.col("ended_ms"))


@query("S10_gate_hold", _gate_sql(""))
def gate_hold(spark, d):
    """Captures leave the gate in groups after a hold; a full gate lets them pass on their own."""
    return gate.gated(_received(spark, d), LIMITS)


def _event_stream(spark, d):
    events = run.as_stream(spark, f"{d}/events.parquet")
    at = F.floor(micros("ts") / 1000)
    return events.select(
        (F.col("user_id") % 3).alias("room"), F.col("user_id").alias("client_id"), F.col("event_id").alias("utterance_id"), at.alias("started_ms"), (at + 600_000).alias("ended_ms"),
        (F.col("value") / 500).alias("avg_rms"), (F.col("value") / 400).alias("peak_rms"), F.col("ts").cast("timestamp").alias("started_at"),
    )


@query("S10_gate_stream", _gate_sql(f", (SELECT max(epoch_us(ts) // 1000) + 600000 - {DELAY_MS} AS mark FROM events) WHERE CASE WHEN bypassed THEN x.received_ms ELSE seed.received_ms + {LIMITS.hold_ms} END < mark"))
def gate_stream(spark, d):
    """S10 as a stream with state and timers: the groups whose hold is over when the watermark has come to its end."""
    received = _event_stream(spark, d).withColumn("received_ms", F.col("ended_ms")).withColumn("received_at", F.timestamp_millis("received_ms"))
    return run.finished(processors.gate_stream(received.withWatermark("received_at", f"{DELAY_MS} milliseconds"), LIMITS))


@query("C1_C3_echo_stream", f"""
    WITH u AS ({UTTERANCES_SQL})
    SELECT a.room, a.utterance_id AS left_id, b.utterance_id AS right_id FROM u a JOIN u b ON a.room = b.room AND a.client_id <> b.client_id
      AND abs(a.started_ms - b.started_ms) <= 65000 AND abs(a.ended_ms - b.ended_ms) <= 90000
      AND greatest(0, least(a.ended_ms, b.ended_ms) - greatest(a.started_ms, b.started_ms)) / least(greatest(1, a.ended_ms - a.started_ms), greatest(1, b.ended_ms - b.started_ms)) >= 0.7
    WHERE a.avg_rms > 0 AND b.avg_rms > 0 AND a.avg_rms / b.avg_rms >= 1.6 AND a.peak_rms / greatest(b.peak_rms, 1e-9) >= 1.25""")
def echo_stream(spark, d):
    """C1, C3 as a join of a stream with itself."""
    pairs = joins.echo_stream(_event_stream(spark, d), delay=f"{DELAY_MS} milliseconds", start_delta=65_000, end_delta=90_000)
    return run.finished(pairs).select("room", "left_id", "right_id")


@query("A1_S1_late_frames", f"""
    WITH e AS (SELECT event_id // 50 AS batch, event_id, user_id, epoch_us(ts) // 1000 AS at_ms FROM events),
    m AS (SELECT batch, max(max(at_ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_MS} AS mark FROM e GROUP BY batch)
    SELECT user_id, count(*) FILTER (coalesce(at_ms < mark, false)) AS late, count(*) FILTER (NOT coalesce(at_ms < mark, false)) AS accepted FROM e JOIN m USING (batch) GROUP BY user_id""")
def late_frames(spark, d):
    """Frames that come later than the watermark allows, fifty frames a batch; each frame is accepted or a reject."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("batch"), "user_id", F.floor(micros("ts") / 1000).alias("at_ms"))
    return late.marked(e, "batch", F.col("at_ms"), DELAY_MS).groupBy("user_id").agg(F.count_if("is_late").alias("late"), F.count_if(~F.col("is_late")).alias("accepted"))


@query("S23_S24_request_lifecycle", """
    SELECT CAST(o_orderkey AS VARCHAR) AS key, r AS request_id, CASE WHEN o_orderkey % 4 = 0 AND r = 'a' THEN 'aborted' WHEN r = 'c' THEN 'conflict'
        WHEN r = 'd' AND o_orderkey % 4 <> 1 THEN 'cached' WHEN r = 'd' THEN 'created' WHEN r = (CASE WHEN o_orderkey % 4 = 0 THEN 'b' ELSE 'a' END) THEN 'created' ELSE 'coalesced' END AS idempotency_status,
      CASE WHEN r = 'c' OR o_orderkey % 4 = 0 AND r = 'a' THEN NULL WHEN r = 'd' AND o_orderkey % 4 = 1 THEN 'd' WHEN o_orderkey % 4 = 0 THEN 'b' ELSE 'a' END AS answered_by
    FROM orders, unnest(['a', 'b', 'c', 'd']) t(r)""")
def request_lifecycle(spark, d):
    """Of four requests a key, the second waits, the third has another fingerprint; leaders abort (a quarter), fail (a quarter) or succeed."""
    k = F.col("o_orderkey") % 4
    event = lambda at, kind, who, print_="f", ok=None: F.struct(
        F.lit(at).cast("long").alias("at_ms"), F.lit(kind).alias("kind"), F.lit(who).alias("request_id"), F.lit(print_).alias("fingerprint"), F.lit(ok).cast("boolean").alias("ok")
    )
    begins = [event(0, "begin", "a"), event(1, "begin", "b"), event(2, "begin", "c", "g")]
    ends = F.when(k == 0, F.array(event(3, "abort", "a"), event(4, "finish", "b", ok=True))).when(k == 1, F.array(event(3, "finish", "a", ok=False))).otherwise(F.array(event(3, "finish", "a", ok=True)))
    last = [event(5, "begin", "d"), event(6, "finish", "d", ok=True)]
    events = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.explode(F.concat(F.array(*begins), ends, F.array(*last))).alias("e")).select("key", "e.*", F.col("e.at_ms").alias("seq"))
    return idempotency.resolved(events).select("key", "request_id", "idempotency_status", "answered_by")


@query("S13_S34_upserted_rows", """
    SELECT user_id, event_type, event_id, revision FROM (SELECT user_id, event_type, event_id, CAST(floor(value) AS BIGINT) AS revision,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value) DESC, event_id) AS place FROM events) WHERE place = 1""")
def upserted_rows(spark, d):
    """A stream of revisions kept as a table of the newest row of each key."""
    stream = run.as_stream(spark, f"{d}/events.parquet").select("user_id", "event_type", "event_id", F.floor("value").alias("revision"))
    folder = run.shared_folder(spark)
    done = upsert.upsert(stream, folder, ["user_id", "event_type"], "revision", buckets=8, availableNow=True)
    done.awaitTermination()
    if done.exception() is not None:
        raise done.exception()
    return upsert.table(spark, folder, stream.schema)


@query("A6_A7_A8_committed_pairs", "SELECT CAST(item_id AS VARCHAR) AS segment_id, CAST(strlen(text) AS INTEGER) AS n_pcm, CAST(strlen(text) // 2 * 2 + 44 AS INTEGER) AS n_wav, lower(sha256(text)) AS pcm_sha256 FROM benchmark")
def committed_pairs(spark, d):
    """Segments written as pairs of samples and WAV file by a data source that publishes all of a write or nothing, and read again."""
    spool.register(spark)
    folder = run.shared_folder(spark).removeprefix("file://")
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("segment_id"), F.col("text").cast("binary").alias("pcm"))
    rows.write.format("audio_pairs").mode("append").save(folder)
    found = spool.pairs(spark, folder)
    return found.select("segment_id", F.octet_length("pcm").alias("n_pcm"), F.octet_length("wav").alias("n_wav"), F.sha2("pcm", 256).alias("pcm_sha256"))
