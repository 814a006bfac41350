"""Packet spool, committed pairs, recovery, the upsert sink and observed counters."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from turnwise.sources import spool
from turnwise.streaming import health, upsert


def test_packets_in_batch_and_as_a_stream(spark, tmp_path, monkeypatch):
    spool.register(spark)
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for i in range(5):
        spool.publish_packet(folder, i, 1000 + i, f"c{i % 2}", bytes([i]) * 4)
    with open(f"{folder}/000000000009-1-x.pcm.abc.part", "wb") as f:
        f.write(b"half")
    batch = spark.read.format("spool").load(folder)
    assert sorted((r.packet_no, r.client_id, r.received_ms, bytes(r.pcm)) for r in batch.collect()) == [(i, f"c{i % 2}", 1000 + i, bytes([i]) * 4) for i in range(5)]
    out = str(tmp_path / "out")
    for more in ((), (5, 6), ()):
        for i in more:
            spool.publish_packet(folder, i, 1000 + i, "c9", b"ab")
        query = spark.readStream.format("spool").load(folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r.packet_no for r in spark.read.parquet(out).collect()) == list(range(7))


def test_pairs_are_committed_together(spark, tmp_path):
    spool.register(spark)
    folder = str(tmp_path / "pairs")
    rows = spark.createDataFrame([(i, bytes([i]) * 320) for i in range(20)], "segment_id int, pcm binary").repartition(4)
    rows.write.format("audio_pairs").mode("append").save(folder)
    got = {r.segment_id: (bytes(r.pcm), bytes(r.wav)) for r in spool.pairs(spark, folder).collect()}
    assert set(got) == {str(i) for i in range(20)}
    assert all(wav[:4] == b"RIFF" and wav.endswith(pcm) for pcm, wav in got.values())

    # A write of which one task dies publishes nothing; what the others wrote is found.
    def dies(batches):
        for b in batches:
            if (b["segment_id"] == 107).any():
                raise RuntimeError("killed")
            yield b

    bad = spark.createDataFrame([(100 + i, bytes(320)) for i in range(20)], "segment_id int, pcm binary").repartitionByRange(4, "segment_id").mapInPandas(dies, "segment_id int, pcm binary")
    with pytest.raises(Exception):
        bad.write.format("audio_pairs").mode("append").save(folder)
    assert spool.committed(spark, folder).count() == 20 and len(spool.pairs(spark, folder).collect()) == 20
    os.makedirs(f"{folder}/{spool.PREVIEWS}")
    open(f"{folder}/{spool.PREVIEWS}/old.wav", "w").close()
    lost = spool.leftovers(spark, folder).count()
    assert spool.recover(spark, folder, str(tmp_path / "rejects")) == lost // 2
    assert os.listdir(f"{folder}/{spool.PREVIEWS}") == []
    if lost:
        assert {r.reason for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {"uncommitted"}


ROWS = "key int, revision int, text string"


def test_replayed_batches_change_nothing(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "t")
    batches = [[(rng.randrange(40), rng.randrange(8), f"b{n}r{i}") for i in range(50)] for n in range(4)]
    want = {}
    for rows in batches:
        for key, revision, text in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
            if key not in want or revision > want[key][0]:
                want[key] = (revision, text)
        # Of one batch the row with the highest revision counts, of equals the first by its other columns.
    for n, rows in enumerate(batches):
        for _ in range(2):
            upsert.merge(spark.createDataFrame(rows, ROWS), n, path, ["key"], "revision", buckets=4)
    schema = spark.createDataFrame([], ROWS).schema
    seen = lambda: {r.key: (r.revision, r.text) for r in upsert.table(spark, path, schema).collect()}
    assert seen() == want
    upsert.merge(spark.createDataFrame(batches[3], ROWS), 3, path, ["key"], "revision", buckets=4)
    assert seen() == want and upsert.table(spark, path, schema).count() == len(want)


def test_upsert_stream_and_health(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    listener = health.Health()
    spark.streams.addListener(listener)
    try:
        for n in range(3):
            spark.createDataFrame([(k, n, f"v{n}") for k in range(10 * (n + 1))], ROWS).coalesce(1).write.mode("append").parquet(source)
            stream = health.observed(spark.readStream.schema(ROWS).parquet(source), "turns", {"late": F.col("revision") < n}, {"key": F.col("key")})
            query = upsert.upsert(stream, path, ["key"], "revision", 8, availableNow=True)
            query.awaitTermination(120)
            assert query.exception() is None
        for _ in range(50):
            if listener.counters().get("turns", {}).get("rows") == 60 and not listener.running:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert {r.key: r.revision for r in upsert.table(spark, path, spark.createDataFrame([], ROWS).schema).collect()} == {k: 2 for k in range(30)}
    assert listener.counters()["turns"] == {"rows": 60, "late": 0, "key": 29}
    assert listener.row() == {"turns_rows": 60, "turns_late": 0, "turns_key": 29, "running": 0, "failed": 0, "ready": True}
