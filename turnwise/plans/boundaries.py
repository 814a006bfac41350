"""Queries across line workers and voice models, with stand-ins that are labelled as such, and what feeds them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import audio, boundary
from ..operators import metrics
from ..registry import query
from ..sources import io
from .common import table


def _stub_line():
    """Stand-in for a worker process: the other side of the line, in this process."""
    lines: list[str] = []
    return lines.append, lambda: boundary.serve(lines[-1], boundary.Lower())


@query("U3_U4_A24_line_worker", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM benchmark")
def line_worker(spark, d):
    """Texts through a worker that answers JSON lines, one worker a task, retried once."""
    out = boundary.postprocessed(F.col("text"), "line", lambda: boundary.LinePostprocessor(_stub_line))
    return table(spark, d, "benchmark").select("item_id", out.alias("text"))


@query("U8_voice_embeddings", "SELECT doc_id, least(strlen(text), 256000)::DOUBLE AS first FROM documents WHERE length(text) * 60 >= 1000")
def voice_embeddings(spark, d):
    """U8: segments long enough, eight seconds at most, through the embedding's boundary (the stand-in counts bytes)."""
    s = table(spark, d, "documents").select("doc_id", (F.length("text") * 60).alias("audio_ms"), F.col("text").cast("binary").alias("pcm"))
    return boundary.embedded(s, _stub_embedder).select("doc_id", F.get("v", F.lit(0)).cast("double").alias("first"))


def _stub_embedder():
    """Stand-in for a voice embedding."""
    return lambda row: {"v": [float(len(row["pcm"]))]}


@query("U9_diarised_segments", """
    SELECT item_id, 0 AS start, strlen(text) // 4 AS "end", 0 AS label FROM benchmark UNION ALL SELECT item_id, strlen(text) // 4, strlen(text) // 2, 1 FROM benchmark""")
def diarised_segments(spark, d):
    """Regions of speakers by the diariser's boundary (the stand-in cuts in half)."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").cast("binary").alias("pcm"))
    return boundary.diarised(b, _stub_diariser).select("item_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label")


def _stub_diariser():
    """Stand-in for a diariser: two speakers, one after the other."""

    def run(row: dict) -> dict:
        n = len(row["pcm"]) // 2
        return {"regions": [{"start": 0, "end": n // 2, "label": 0}, {"start": n // 2, "end": n, "label": 1}]}

    return run


@query("H50_resampled", "SELECT vec_id, array_to_string(list_transform(range(0, len(embedding) // 3), lambda i: CAST(round(embedding[3 * i + 1]::DOUBLE * 1000000) AS BIGINT)), ',') AS samples FROM embeddings")
def resampled(spark, d):
    """Samples of 48 kHz at 16 kHz."""
    out = audio.resample_pcm(F.transform("embedding", lambda x: x.cast("double")), 48_000)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(out, lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ",").alias("samples"))


@query("H64_verb_map", """
    WITH l AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_size FROM part)
    SELECT w1 || '_VB_T' || (p_size % 3) AS key, min_by(w2, p_partkey) AS verb FROM l GROUP BY ALL""")
def verb_map(spark, d):
    """Lines of verb forms (names of parts stand for them) as a map; the first of a key wins."""
    w = F.split("p_name", " ")
    line = F.concat(w[0], F.lit("_"), F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit(":VB_T"), (F.col("p_size") % 3).cast("string"), F.lit(" "))
    return io.verb_map(table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), line.alias("value")))


@query("D26_tree_size", "SELECT p_size AS model, count(*) AS files, CAST(sum(strlen(p_name)) AS BIGINT) AS bytes FROM part GROUP BY p_size")
def tree_size(spark, d):
    """Bytes of all files of a model (parts of a size stand for them)."""
    files = table(spark, d, "part").select(F.col("p_size").alias("model"), F.octet_length("p_name").alias("length"))
    return metrics.tree_size(files, "model")


@query("D27_real_time_factor", "SELECT item_id, CASE WHEN strlen(text) // 2 > 0 THEN (item_id % 9 + 1) / (strlen(text) // 2 / 16000.0) ELSE 0 END AS factor FROM benchmark")
def real_time_factor(spark, d):
    """Time taken over length of audio, 0 for none."""
    seconds = F.floor(F.octet_length("text") / 2) / float(audio.RATE)
    return table(spark, d, "benchmark").select("item_id", metrics.real_time_factor(F.col("item_id") % 9 + 1, seconds).alias("factor"))


@query("H50_A33_resampled_packets", """
    WITH c AS (SELECT vec_id // 8 AS client_id, flatten(list(list_transform(embedding, lambda x: x::DOUBLE) ORDER BY vec_id)) AS x FROM embeddings GROUP BY 1),
    k AS (SELECT client_id, x, unnest(range(0, CAST(ceil((len(x) - 1) * 16000 / 44100.0) AS BIGINT))) AS k FROM c)
    SELECT client_id, k, round(x[k * 44100 // 16000 + 1] + (x[k * 44100 // 16000 + 2] - x[k * 44100 // 16000 + 1]) * (k * 44100 % 16000 / 16000.0), 9) AS sample FROM k""")
def resampled_packets(spark, d):
    """Captures of 44.1 kHz that come in packets, at 16 kHz; positions fall between samples and packets."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("client_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    out = audio.resampled_packets(e, ["client_id"], "vec_id", 44_100)
    each = out.select("client_id", F.col("vec_id").alias("packet"), F.posexplode("out").alias("i", "sample"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("packet", "i")) - 1
    return each.select("client_id", place.cast("long").alias("k"), F.round("sample", 9).alias("sample"))
