"""Previews from request to display, bounded queues and room status, against plain versions."""

import random

from pyspark.sql import functions as F

from turnwise.operators import previews
from turnwise.streaming.stateful import confirm

REQUEST = "lane string, ts_ms bigint, event_id bigint, is_final boolean, client_id string, turn_id int, utterance_id int, pcm binary, language string"


def scheduled(rows, interval=1200, preview=600, final=900):
    """Requests of one lane that are decoded to the end, one after the other."""
    last, busy, running, kept = None, float("-inf"), None, []
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if r[3]:
            if running and r[1] < running[1]:
                kept.remove(running[0])
            running, busy = None, r[1] + final
        elif r[1] >= busy and not (running and r[1] < running[1]) and not (last is not None and r[1] - last < interval):
            kept.append(r)
            last, running = r[1], (r, r[1] + preview)
    return kept


def test_published_previews_equal_a_plain_version(spark):
    def recogniser():
        def run(row):
            text = bytes(row["pcm"]).decode()
            if text.startswith("fail"):
                raise TimeoutError
            return {"reply": "SKIP\tquiet" if text.startswith("skip") else f"OK\t{row['language']}\t{text}"}

        return run

    rnd = random.Random(11)
    texts = ["we will meet at noon", "we will meet at noon today", "we will meet tomorrow", "", "skip", "fail", "no no no no no no", "other words are said here"]
    rows = []
    for lane in ("a", "b", None):
        at = 0
        for i in range(150):
            at += rnd.choice([100, 500, 900, 1300, 2500])
            # Samples for two seconds, so that no text is too much for them; blanks count for nothing.
            pcm = (rnd.choice(texts)).ljust(64_000).encode()
            rows.append((lane, at, i, rnd.random() < 0.15, lane or "n", i // 12, i // 12, pcm, rnd.choice(["en", "en", "en", "fr"])))
    rnd.shuffle(rows)
    want = []
    for lane in ("a", "b"):
        held = {}
        for r in scheduled([x for x in rows if x[0] == lane]):
            text = r[7].decode().strip()
            if r[8] != "en" or text in ("", "skip", "fail", "no no no no no no"):
                continue
            *held[r[5]], shown = confirm(*held.get(r[5], ("", 0, "")), text)
            if shown is not None:
                want.append((lane, r[5], r[2], shown))
    got = previews.published(spark.createDataFrame(rows, REQUEST).repartition(4), "lane", recogniser).collect()
    assert sorted((r.client_id, r.turn_id, r.event_id, r.text) for r in got) == sorted(want) and want
    assert previews.published(spark.createDataFrame([], REQUEST), "lane", recogniser).count() == 0


def test_queues_refuse_what_they_cannot_hold(spark):
    rows = [(1, i, "queue", i % 20, True) for i in range(20)] + [(1, 20, "queue", 3, True), (1, 21, "take", None, None), (1, 22, "queue", 0, True), (1, 23, "queue", 17, True), (1, 24, "done", 0, None), (1, 25, "done", 0, None)]
    rows += [(2, 0, "take", None, None), (2, 1, "queue", 5, None), (2, 2, "other", 5, True), (None, 0, "queue", 5, True)]
    df = spark.createDataFrame(rows, "lane int, at int, kind string, job int, is_final boolean")
    got = {(r.lane, r["at"]): (r.job, r.status) for r in previews.admitted(df, "lane", ["at"]).collect()}
    assert [got[1, i][1] for i in range(20)] == ["queued"] * 16 + ["queue-full"] * 4
    assert [got.get((1, i)) for i in range(20, 26)] == [(3, "coalesced"), (0, "taken"), (0, "coalesced"), (17, "queued"), (0, "done"), None]
    assert {k: v for k, v in got.items() if k[0] != 1} == {(2, 1): (5, "not-final"), (None, 0): (5, "queued")}


def test_room_status_counts_clients_one_by_one(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["x", "y", "z", None]), 1000 * (i // 3), i, rnd.choice(["r1", "r1", "r2", None]), rnd.choice(["on", "off", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "client string, at_ms bigint, seq bigint, room string, state string")
    now, want = {}, []
    for client, at, seq, room, state in rows:
        old = now.get(client, (None, None))[0]
        now[client] = (room, state)
        for r in {old, room} - {None}:
            here = [s for place, s in now.values() if place == r]
            want.append((r, at, seq, len(here), here.count("on")))
    for block in (1, 7000, 10**9):
        got = previews.room_status(df.repartition(3), "client", "at_ms", "seq", ["on"], block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert previews.room_status(df.where(F.lit(False)), "client", "at_ms", "seq", ["on"]).count() == 0
