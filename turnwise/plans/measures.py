"""Queries on metrics, hashes, vectors, idempotency, set operations (families D, F, G, H, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import audio, boundary, hashing
from ..operators import idempotency, identity, metrics, sessions
from ..registry import query
from ..streaming import stateful
from .common import micros, table


def _stub_model():
    """Stand-in for a model: a name in capitals; every fifth isn't there."""

    def run(row: dict) -> dict:
        if row["model"] % 5 == 0:
            raise ValueError("no such model")
        return {"actual": row["p_name"].upper()}

    return run


@query("D9_latency", """
    SELECT event_type, max(value) AS max_ms, sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS total_ms, max_by(value, event_id) AS last_ms, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / greatest(1, count(*)), 1) AS avg_ms FROM events GROUP BY event_type""")
def latency(spark, d):
    """Last, largest, total and mean latency."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0
    return table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("max_ms"), cents.alias("total_ms"), F.max_by("value", "event_id").alias("last_ms"), F.round(cents / F.greatest(F.lit(1), F.count("*")), 1).alias("avg_ms"))


def _rank_sql(p: float, rounding: str = "round") -> str:
    return f"list_sort(list(l_extendedprice))[CAST({rounding}((count(*) - 1) * {p}) AS BIGINT) + 1]"


@query("D10_nearest_rank", f"SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean_ms, {_rank_sql(0.5)} AS p50_ms, {_rank_sql(0.95)} AS p95_ms, min(l_extendedprice) AS min_ms, max(l_extendedprice) AS max_ms FROM lineitem GROUP BY l_returnflag")
def nearest_rank(spark, d):
    """Nearest-rank percentiles, from counts by value instead of a list of all values."""
    l = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    base = l.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean_ms"), F.min("l_extendedprice").alias("min_ms"), F.max("l_extendedprice").alias("max_ms"))
    return base.join(metrics.histogram_ranks(l, ["l_returnflag"], "l_extendedprice", {"p50_ms": 0.5, "p95_ms": 0.95}), "l_returnflag")


@query("D11_half_even_rank", "SELECT l_orderkey, list_sort(list(l_quantity))[CAST(round_even((count(*) - 1) * 0.5, 0) AS BIGINT) + 1] AS p50 FROM lineitem GROUP BY l_orderkey")
def half_even_rank(spark, d):
    """As D10, with ties of the index rounded to even."""
    return metrics.histogram_ranks(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", {"p50": metrics.half_even(0.5)})


@query("D12_upper_median", "SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS p50, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey")
def upper_median(spark, d):
    """The upper median."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    ends = l.groupBy("l_orderkey").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    return ends.join(metrics.histogram_ranks(l, ["l_orderkey"], "l_quantity", {"p50": metrics.upper_middle}), "l_orderkey")


@query("D13_stage_summary", """
    WITH s AS (SELECT l_returnflag, stage, ms FROM lineitem UNPIVOT (ms FOR stage IN (l_quantity, l_discount, l_tax)))
    SELECT l_returnflag, stage, round(avg(ms), 6) AS mean_ms, list_sort(list(ms))[CAST(round((count(*) - 1) * 0.5) AS BIGINT) + 1] AS p50_ms FROM s GROUP BY ALL""")
def stage_summary(spark, d):
    """Stages turned to rows and summed up each on its own."""
    l = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    s = l.unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "stage", "ms")
    p50 = metrics.histogram_ranks(s, ["l_returnflag", "stage"], "ms", {"p50_ms": 0.5})
    return s.groupBy("l_returnflag", "stage").agg(F.round(F.avg("ms"), 6).alias("mean_ms")).join(p50, ["l_returnflag", "stage"])


@query("D14_D28_candidate_scores", """
    WITH c AS (SELECT unnest(['keep', 'lower', 'plain']) AS candidate, item_id, text AS reference FROM benchmark),
    o AS (SELECT *, CASE candidate WHEN 'keep' THEN reference WHEN 'lower' THEN lower(reference) ELSE regexp_replace(reference, '[.,]', '', 'g') END AS output, (item_id % 7 + 1) * 1.5 AS ms FROM c),
    s AS (SELECT *, output = reference AS exact, regexp_replace(output, '[^.,:?!]', '', 'g') = regexp_replace(reference, '[^.,:?!]', '', 'g') AS marks,
      CASE candidate WHEN 'keep' THEN 0 WHEN 'lower' THEN length(regexp_replace(reference, '\\P{Lu}', '', 'g')) ELSE length(reference) - length(output) END / greatest(1, length(reference)) AS rate FROM o)
    SELECT candidate, count(*) AS cases, count(*) FILTER (exact) AS exact, count(*) FILTER (exact) / count(*) AS exact_rate, count(*) FILTER (marks) AS punctuation_exact, count(*) FILTER (marks) / count(*) AS punctuation_rate,
      round(avg(rate), 9) AS mean_edit_rate, count(*) FILTER (NOT (exact AND marks)) AS mismatches, bool_and(exact AND marks) AS all_match, avg(ms) AS mean_ms FROM s GROUP BY candidate""")
def candidate_scores(spark, d):
    """Three candidates (the text itself, in lower case, without commas and full stops) scored against the benchmark's texts."""
    b = table(spark, d, "benchmark").select(F.explode(F.array(F.lit("keep"), F.lit("lower"), F.lit("plain"))).alias("candidate"), "item_id", F.col("text").alias("reference"))
    output = F.when(F.col("candidate") == "keep", F.col("reference")).when(F.col("candidate") == "lower", F.lower("reference")).otherwise(F.regexp_replace("reference", "[.,]", ""))
    cases = b.select("candidate", "reference", output.alias("output"), ((F.col("item_id") % 7 + 1) * 1.5).alias("elapsed_ms"))
    return metrics.candidate_scores(cases, "candidate").withColumn("mean_edit_rate", F.round("mean_edit_rate", 9))


@query("D15_turn_summary", """
    SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (role = 'user') AS asked, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def turn_summary(spark, d):
    """What the interface shows of a turn."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("asked"), F.max_by("role", "turn").alias("last_role"))


@query("D29_D30_probe_results", """
    SELECT p_partkey AS model, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE upper(p_name) END AS actual, CASE WHEN p_partkey % 5 = 0 THEN 'ValueError: no such model' END AS error,
      p_partkey % 5 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 3 <> 0) AS passed FROM part""")
def probe_results(spark, d):
    """Each model probed by a call (a stand-in puts names in capitals and fails for some); a failure is a row, not the end."""
    expected = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 0, F.lit("other")).otherwise(F.upper("p_name"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("model"), "p_name", expected.alias("expected"))
    return metrics.probed(boundary.called(rows, "probe", _stub_model, ["model", "p_name"], "actual string")).select("model", "actual", "error", "passed")


#: Orders as cached answers: the order's date is the expiry, its status the reply's and whether work on it is done.
_CACHE_SQL = """WITH r AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS key_hash, epoch_us(o_orderdate) // 1000 AS expires_at_ms,
    CASE o_orderstatus WHEN 'O' THEN 200 WHEN 'F' THEN 404 ELSE 202 END AS status, o_orderstatus <> 'P' AS completed FROM orders)"""
_CACHE_NOW = 820_454_400_000


def _cache(spark, d):
    o, state = table(spark, d, "orders"), F.col("o_orderstatus")
    status = F.when(state == "O", 200).when(state == "F", 404).otherwise(202)
    return o.select(hashing.sha256(F.col("o_orderkey").cast("string")).alias("key_hash"), F.floor(micros("o_orderdate") / 1000).alias("expires_at_ms"), status.alias("status"), (state != "P").alias("completed"))


@query("F6_cache_load", _CACHE_SQL + f"SELECT key_hash, expires_at_ms, status FROM r WHERE expires_at_ms > {_CACHE_NOW} AND status BETWEEN 200 AND 299 ORDER BY expires_at_ms DESC, key_hash LIMIT 1000")
def cache_load(spark, d):
    """Unexpired answers, latest expiry first; the limit is the feature."""
    return idempotency.cache_to_load(_cache(spark, d), _CACHE_NOW, 1000).select("key_hash", "expires_at_ms", "status")


@query("F7_cache_files_to_delete", _CACHE_SQL + "SELECT key_hash FROM (SELECT key_hash, row_number() OVER (ORDER BY expires_at_ms DESC, key_hash) AS n FROM r) WHERE n > 500")
def cache_files(spark, d):
    """all files but those of the 500 newest answers."""
    return idempotency.files_to_delete(_cache(spark, d), 500).select("key_hash")


@query("F8_cache_evictions", _CACHE_SQL + "SELECT key_hash FROM (SELECT key_hash, row_number() OVER (ORDER BY expires_at_ms, key_hash) AS n FROM r WHERE completed) WHERE n <= (SELECT greatest(0, count(*) - 600) FROM r)")
def cache_evictions(spark, d):
    """F8: completed answers that expire soonest, as many as are over 600; work in progress stays."""
    return idempotency.to_evict(_cache(spark, d), 600).select("key_hash")


@query("A30_cache_files", _CACHE_SQL + f"SELECT key_hash, expires_at_ms, status FROM r WHERE expires_at_ms > {_CACHE_NOW} AND status BETWEEN 200 AND 299")
def cache_files_read(spark, d):
    """Answers as JSON records, and what of them is read back: unexpired successes."""
    lines = _cache(spark, d).select(F.to_json(F.struct("key_hash", "expires_at_ms", "status")).alias("record"))
    return idempotency.loadable(lines.select(F.from_json("record", "key_hash string, expires_at_ms bigint, status int").alias("r")).select("r.*"), _CACHE_NOW)


@query("G4_first_of_length", "SELECT source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source, n_chars")
def first_of_length(spark, d):
    """The first case of each length."""
    return table(spark, d, "documents").groupBy("source", "n_chars").agg(F.min("doc_id").alias("doc_id"))


@query("G6_S22_coalesced_jobs", """
    SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 450) GROUP BY user_id""")
def coalesced_jobs(spark, d):
    """One job a key, none for keys that run."""
    e = table(spark, d, "events")
    jobs = e.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("seq"))
    running = e.where("event_type = 'error' and value > 450").select("user_id").distinct()
    return idempotency.coalesced_jobs(jobs, running, "user_id").select("user_id", "event_id")


@query("G8_long_ids", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\\S+')) >= 3")
def long_ids(spark, d):
    """Rows that aren't too short."""
    return table(spark, d, "documents").where(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) >= 3).select("doc_id")


@query("G9_membership", """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS loaded, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS warm, c_custkey IN (SELECT user_id FROM events) AS resolved FROM customer""")
def membership(spark, d):
    """Three set memberships of each key."""
    o, e, out = table(spark, d, "orders"), table(spark, d, "events"), table(spark, d, "customer").select("c_custkey")
    for name, ids in (("loaded", o.where("o_orderstatus = 'O'").select("o_custkey")), ("warm", o.where("o_orderstatus = 'F'").select("o_custkey")), ("resolved", e.select("user_id"))):
        key = ids.columns[0]
        known = ids.distinct().select(F.col(key).alias("c_custkey"), F.lit(True).alias(name))
        out = out.join(known, "c_custkey", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query("H44_C7_dot_products", """
    SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 50 = 0""")
def dot_products(spark, d):
    """Inner products of queries with the rows of their room."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    p = q.join(e, "label").where("query_id <> vec_id")
    return p.select("query_id", "vec_id", F.round(identity.dot(F.col("q"), F.col("embedding")), 6).alias("score"))


@query("H45_E13_best_speakers", """
    WITH s AS (SELECT label, min(vec_id) AS speaker_id, label % 3 AS room FROM embeddings GROUP BY label), c AS (SELECT s.room, s.speaker_id, e.embedding AS c FROM s JOIN embeddings e ON e.vec_id = s.speaker_id),
    p AS (SELECT e.vec_id, c.room, c.speaker_id, list_dot_product(e.embedding::DOUBLE[], c.c::DOUBLE[]) AS score FROM embeddings e JOIN c ON e.label % 3 = c.room),
    r AS (SELECT *, row_number() OVER (PARTITION BY room, vec_id ORDER BY score DESC, speaker_id) AS place FROM p)
    SELECT room, vec_id AS id, max(speaker_id) FILTER (place = 1) AS best_id, round(max(score) FILTER (place = 1), 6) AS best, round(coalesce(max(score) FILTER (place = 2), -1), 6) AS second FROM r WHERE place <= 2 GROUP BY room, vec_id""")
def best_speakers(spark, d):
    """Best and second speaker of each voice."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("f"))
    speakers = first.select((F.col("label") % 3).alias("room"), F.col("f.vec_id").alias("speaker_id"), F.col("f.embedding").alias("centroid"))
    voices = e.select((F.col("label") % 3).alias("room"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return identity.best_two(voices, speakers).select("room", "id", "best_id", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"))


@query("S16_D20_D21_identity")
def speaker_identity(spark, d):
    """Voices of a room assigned in order, at a threshold that the test data reach."""
    e = table(spark, d, "embeddings").select((F.col("label") % 3).alias("room"), "vec_id", F.col("embedding").alias("v"))
    return identity.assigned(e, "room", ["vec_id"], threshold=0.45)


@query("H46_D22_softmax", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS x FROM embeddings)
    SELECT vec_id, round(list_max(x) / list_sum(x), 6) AS top_probability, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS argmax FROM v""")
def softmax(spark, d):
    """Shifted softmax and its largest element."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double") - F.array_max("embedding").cast("double"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x)
    last = F.size("x") - F.array_position(F.reverse("x"), F.array_max("x")).cast("int")
    return v.select("vec_id", F.round(F.array_max("x") / total, 6).alias("top_probability"), last.alias("argmax"))


@query("H47_H53_audio_arithmetic", """
    SELECT event_id, CAST(floor(value) AS BIGINT) * 640 * 1000 // 32000 AS ms, CAST(ceil(value * 16000 * 1 * 2) AS BIGINT) + 44 AS wav_bytes, CASE WHEN value >= 0 THEN value END AS seconds FROM events""")
def audio_arithmetic(spark, d):
    """Bytes, milliseconds and sizes."""
    n = F.floor("value") * 640
    return table(spark, d, "events").select("event_id", audio.bytes_to_ms(n).alias("ms"), audio.wav_estimate(F.col("value"), F.lit(16000), F.lit(1)).alias("wav_bytes"), audio.parse_seconds(F.col("value").cast("string")).alias("seconds"))


@query("H49_quantise", """SELECT event_id, CAST(floor(CASE WHEN x < 0 THEN x * 32768 ELSE x * 32767 END + 0.5) AS INTEGER) AS sample FROM (SELECT event_id, greatest(-1.0, least(1.0, (value - 245) / 200)) AS x FROM events)""")
def quantise(spark, d):
    """Float samples as 16-bit integers."""
    return table(spark, d, "events").select("event_id", audio.quantise((F.col("value") - 245) / 200).alias("sample"))


@query("H48_decoder_padding", """
    WITH e AS (SELECT vec_id, embedding[1:vec_id % 65]::DOUBLE[] AS x FROM embeddings), n AS (SELECT *, greatest(0, 40 - len(x)) AS missing FROM e)
    SELECT vec_id, array_to_string(list_transform(list_concat(list_concat(list_resize([]::DOUBLE[], missing // 2, 0.0), x), list_resize([]::DOUBLE[], missing - missing // 2, 0.0)), lambda v: CAST(round(v * 1000000) AS BIGINT)), ',') AS padded FROM n""")
def decoder_padding(spark, d):
    """Arrays of 0 to 64 samples with zeros on both sides up to 40, the one more on the right."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, (F.col("vec_id") % 65).cast("int")).alias("x"))
    p = e.select("vec_id", audio.pad_for_decoder(F.transform("x", lambda v: v.cast("double")), 40).alias("p"))
    return p.select("vec_id", F.array_join(F.transform("p", lambda v: F.round(v * 1_000_000).cast("bigint").cast("string")), ",").alias("padded"))


@query("H51_H52_hashes", "SELECT p_partkey, sha256(p_name) AS name_hash FROM part")
def hashes(spark, d):
    """Content hashes."""
    return table(spark, d, "part").select("p_partkey", hashing.sha256(F.col("p_name")).alias("name_hash"))


@query("H52_fingerprints", """
    WITH p AS (SELECT p_partkey, p_name AS a, p_brand AS b FROM part)
    SELECT p_partkey, sha256(unhex(lpad(hex(strlen(a)), 16, '0')) || encode(a) || unhex(lpad(hex(strlen(b)), 16, '0')) || encode(b)) AS fingerprint FROM p""")
def fingerprints(spark, d):
    """A hash over fields behind their lengths."""
    return table(spark, d, "part").select("p_partkey", hashing.fingerprint(F.col("p_name"), F.col("p_brand")).alias("fingerprint"))


@query("H55_H56_ids_and_backoff", """
    SELECT p_partkey, printf('SPEAKER_%02d', p_size) AS speaker, substring('turn-' || p_partkey || '-s' || (p_size + 1), 1, 64) AS segment_id, least(120.0, 30.0 * pow(2.0, least(6, p_size % 8))) AS wait_s FROM part""")
def ids_and_backoff(spark, d):
    """Formatted ids and waiting times."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.format_string("SPEAKER_%02d", "p_size").alias("speaker"), F.substring(F.concat(F.lit("turn-"), F.col("p_partkey").cast("string"), F.lit("-s"), (F.col("p_size") + 1).cast("string")), 1, 64).alias("segment_id"), hashing.backoff(F.col("p_size") % 8 + 1).alias("wait_s"))


@query("H57_B16_error_classes", """
    WITH m AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ffmpeg not found' WHEN 1 THEN 'request body exceeds max_upload_mb = ' || (event_id % 50) || ' now' ELSE 'CAPU request timed out' END AS message FROM events)
    SELECT event_id, CASE WHEN message LIKE '%ffmpeg not found%' OR message LIKE '%CAPU request timed out%' THEN 'server_error' ELSE 'invalid_request_error' END AS error_type, CASE WHEN message LIKE '%timed out%' THEN 504 WHEN message LIKE '%ffmpeg%' THEN 500 ELSE 400 END AS status,
      TRY_CAST(nullif(regexp_extract(message, 'max_upload_mb = ([0-9]+)', 1), '') AS BIGINT) AS max_mb FROM m""")
def error_classes(spark, d):
    """Messages to status, class and the number in them."""
    e = table(spark, d, "events")
    m = F.when(F.col("event_id") % 3 == 0, "ffmpeg not found").when(F.col("event_id") % 3 == 1, F.concat(F.lit("request body exceeds max_upload_mb = "), (F.col("event_id") % 50).cast("string"), F.lit(" now"))).otherwise("CAPU request timed out")
    e = e.select("event_id", m.alias("message"))
    kind = F.when(F.col("message").contains("ffmpeg not found") | F.col("message").contains("CAPU request timed out"), "server_error").otherwise("invalid_request_error")
    status = F.when(F.col("message").contains("timed out"), 504).when(F.col("message").contains("ffmpeg"), 500).otherwise(400)
    return e.select("event_id", kind.alias("error_type"), status.alias("status"), F.nullif(F.regexp_extract("message", "max_upload_mb = ([0-9]+)", 1), F.lit("")).cast("bigint").alias("max_mb"))


@query("B17_language_preference", """
    WITH h AS (SELECT event_id, 'vi;q=0.' || (event_id % 10) || ', en-US;q=0.5' AS header FROM events) SELECT event_id, (event_id % 10) / 10.0 >= 0.5 AS prefers_vi FROM h""")
def language_preference(spark, d):
    """Weighted language lists; the first family wins ties."""
    header = F.concat(F.lit("vi;q=0."), (F.col("event_id") % 10).cast("string"), F.lit(", en-US;q=0.5"))
    parts = F.transform(F.split(F.lower(header), ","), lambda p: F.trim(p))

    def weight(family: str):
        own = F.filter(parts, lambda p: p.startswith(family))
        q = F.transform(own, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r";\s*q=([0-9.]+)", 1), F.lit("")).cast("double"), F.lit(1.0)))
        return F.coalesce(F.array_max(q), F.lit(-1.0))

    return table(spark, d, "events").select("event_id", ((weight("vi") >= 0) & (weight("vi") >= weight("en"))).alias("prefers_vi"))


@query("S23_S24_idempotency", """
    WITH r AS (SELECT o_orderkey AS key, seq, CASE WHEN seq = 3 AND o_orderkey % 5 = 0 THEN 'other' ELSE 'own' END AS fingerprint FROM orders, unnest([1, 2, 3]) t(seq))
    SELECT key, seq, CASE WHEN seq = 1 THEN 'created' WHEN fingerprint = first_value(fingerprint) OVER (PARTITION BY key ORDER BY seq) THEN 'cached' ELSE 'conflict' END AS idempotency_status FROM r""")
def idempotent(spark, d):
    """Created, cached or conflict, for three requests of each key."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)])).alias("seq"))
    r = o.select("key", "seq", (F.col("seq") * 1000).alias("at_ms"), F.when((F.col("seq") == 3) & (F.col("key") % 5 == 0), "other").otherwise("own").alias("fingerprint"), F.lit(True).alias("ok"))
    return idempotency.statuses(r).select("key", F.col("seq").cast("int").alias("seq"), "idempotency_status")


@query("S20_H61_token_bucket", """
    WITH RECURSIVE e AS (SELECT user_id AS client_id, event_id, epoch_us(ts) AS t, CAST(floor(value) AS BIGINT) * 640 AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT client_id, event_id, t, n, size <= 320000.0 AS accepted, CASE WHEN size <= 320000.0 THEN 320000.0::DOUBLE - size ELSE 320000.0::DOUBLE END AS tokens FROM e WHERE n = 1
      UNION ALL SELECT e.client_id, e.event_id, e.t, e.n, e.size <= least(320000.0::DOUBLE, b.tokens + (e.t - b.t) / 1e6 * 5.0),
        least(320000.0::DOUBLE, b.tokens + (e.t - b.t) / 1e6 * 5.0) - CASE WHEN e.size <= least(320000.0::DOUBLE, b.tokens + (e.t - b.t) / 1e6 * 5.0) THEN e.size ELSE 0 END
      FROM b JOIN e ON e.client_id = b.client_id AND e.n = b.n + 1)
    SELECT client_id, event_id, accepted, round(tokens, 3) AS tokens FROM b""")
def token_bucket(spark, d):
    """Which packets the token bucket of each client lets through."""
    e = table(spark, d, "events").select(F.col("user_id").alias("client_id"), micros("ts").alias("ts_us"), "event_id", (F.floor("value") * 640).cast("bigint").alias("size"))
    return stateful.admitted(e, rate=5.0, burst=320_000.0).withColumn("tokens", F.round("tokens", 3))


@query("S1_reframing", """
    WITH p AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) * 2 AS size, sum(CAST(floor(value) AS BIGINT) * 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events)
    SELECT user_id, event_id, CAST(total // 640 AS BIGINT) AS frames, CAST(total % 640 AS BIGINT) AS remainder FROM p""")
def reframing(spark, d):
    """Whole frames and the rest after each packet."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    p = table(spark, d, "events").withColumn("total", F.sum(F.floor("value") * 2).over(w))
    return p.select("user_id", "event_id", F.floor(F.col("total") / audio.FRAME_BYTES).alias("frames"), (F.col("total") % audio.FRAME_BYTES).alias("remainder"))


@query("S9_two_hit_confirmation")
def two_hits(spark, d):
    """Previews of a turn (its first half, three quarters, and the whole of it twice) that a second, similar one confirms."""
    w = F.split(F.col("text"), " ")
    part = lambda share: F.array_join(F.slice(w, F.lit(1), F.ceil(F.size(w) * share).cast("int")), " ")
    previews = F.posexplode(F.array(part(0.5), part(0.75), F.col("text"), F.col("text"))).alias("preview", "text")
    c = table(spark, d, "conversations").select("conv_id", "turn", previews)
    return stateful.confirmed(c, ["conv_id", "turn"])


@query("S21_latest_wins", "SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, epoch_us(ts) // 3600000000 // 24")
def latest_wins(spark, d):
    """The newest job of each key in a batch."""
    e = table(spark, d, "events").select("user_id", F.floor(micros("ts") / 3_600_000_000 / 24).alias("day"), "event_id", "value")
    return sessions.latest(e, ["user_id", "day"], "event_id").select("user_id", "event_id", "value")


@query("A5_A13_wav_round_trip", "SELECT item_id, strlen(text) // 2 * 2 + 44 AS wav_bytes, 16000 AS sample_rate, 1 AS channels, strlen(text) // 2 / 16000.0 AS duration FROM benchmark")
def wav_round_trip(spark, d):
    """Bytes as a WAV file, and what its header says."""
    b = table(spark, d, "benchmark").select("item_id", audio.to_wav(F.col("text").cast("binary")).alias("wav")).where(audio.is_wav("wav"))
    p = b.select("item_id", F.octet_length("wav").cast("bigint").alias("wav_bytes"), audio.probe_audio("wav").alias("p"))
    return p.select("item_id", "wav_bytes", "p.sample_rate", "p.channels", "p.duration")


@query("D1_pcm_levels", """
    WITH h AS (SELECT item_id, hex(encode(text)) AS h, strlen(text) // 2 AS n FROM benchmark),
    s AS (SELECT item_id, n, list_transform(range(0, n), lambda i: CAST('0x' || h[4 * i + 3:4 * i + 4] || h[4 * i + 1:4 * i + 2] AS INTEGER)) AS u FROM h),
    v AS (SELECT item_id, n, list_transform(u, lambda x: CAST(CASE WHEN x >= 32768 THEN x - 65536 ELSE x END AS BIGINT)) AS x FROM s)
    SELECT item_id, CASE WHEN n = 0 THEN 0 ELSE round(sqrt(list_sum(list_transform(x, lambda y: y * y)) / n) / 32768, 9) END AS rms, CASE WHEN n = 0 THEN 0 ELSE list_max(list_transform(x, lambda y: abs(y))) / 32768.0 END::DOUBLE AS peak FROM v""")
def pcm_levels(spark, d):
    """Root mean square and peak of binary samples."""
    b = table(spark, d, "benchmark").select("item_id", audio.pcm_stats(F.col("text").cast("binary")).alias("s"))
    return b.select("item_id", F.round("s.rms", 9).alias("rms"), "s.peak")


@query("A15_audio_slices", "SELECT item_id, substring(hex(encode(text)), 65, 128) AS slice FROM benchmark")
def audio_slices(spark, d):
    """A slice of audio by time."""
    return table(spark, d, "benchmark").select("item_id", F.hex(audio.slice_pcm(F.col("text").cast("binary"), F.lit(0.001), F.lit(0.002))).alias("slice"))


@query("H63_collected_samples", """
    WITH h AS (SELECT item_id, hex(encode(text)) AS h, strlen(text) // 2 AS n FROM benchmark)
    SELECT item_id, substring(h, 1, 4 * least(20, n)) || substring(h, 121, 4 * greatest(0, least(80, n - 30))) || substring(h, 161, 4 * greatest(0, least(80 - greatest(0, least(80, n - 30)), n - 40))) AS samples FROM h""")
def collected_samples(spark, d):
    """The samples of several ranges, held to what there is and to 100 in all."""
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    ranges = F.array(span(-5, 20), span(9, 9), span(30, 130), span(40, 100_000))
    return table(spark, d, "benchmark").select("item_id", F.hex(audio.collect_samples(F.col("text").cast("binary"), ranges, 100)).alias("samples"))
