"""Final utterances and diarised clips against plain, sequential versions; models are called where a rule asks only."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import identity, recognition, reid
from turnwise.operators.align import merge_rolling

UTTERANCES = "room string, client_id string, turn_id string, segment_index int, window binary, pcm binary, language_pref string, context_prefix_ms long, audio_ms long"
WORDS = "red green blue seven eight nine house river stone cloud walks sings under over early late".split()


def model(log=None):
    """Audio is its own text here: ``language|text``; some audio fails, some says nothing."""

    def build():
        def run(row):
            if log:
                with open(log, "a") as f:
                    f.write("x\n")
            language, _, text = bytes(row["pcm"]).decode().partition("|")
            if language == "fail":
                raise ValueError("no model")
            return {"ok": language != "none", "text": text, "language": language, "reason": text if language == "none" else None}

        return run

    return build


def utterances(seed):
    rng, rows = random.Random(seed), []
    for turn in range(12):
        said = []
        for i in range(rng.randint(1, 7)):
            new = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
            context = said[-rng.randint(0, 8) :] if said else []
            window = context + new
            kind = rng.random()
            language = rng.choice(["en", "vi"])
            solo = f"{language}|{' '.join(new)}"
            if kind < 0.10:
                window = [*context, "loop", "loop", "loop", *new]  # repeats, with a context or without
            elif kind < 0.25:
                window = [rng.choice(["amber", "olive", "teal", "ivory"]) + str(rng.randint(0, 99)) for _ in range(5)]  # nothing to align with
                if rng.random() < 0.3:
                    solo = rng.choice(["fail|", "none|", "xx|other language", "en|слово", "en|..."])
            whole = f"{language}|{' '.join(window)}"
            if kind > 0.93:
                whole = rng.choice(["fail|", "none|", "none|noise", "de|guten tag", "en|...", "en|слово"])
            rows.append(("r", f"c{turn % 3}", f"t{turn}", i, whole.encode(), solo.encode(), language, 900 * len(context), 900 * len(new) + 1000))
            said += new
    return rows


def plain(spark, rows):
    """One utterance after the other, as a server would; reasons come from the column rule, one text at a time in bulk."""
    texts = sorted({bytes(b).decode().partition("|")[2] for r in rows for b in (r[4], r[5])})
    times = sorted({r[7] + r[8] for r in rows} | {r[8] for r in rows})
    df = spark.createDataFrame([(t, m) for t in texts for m in times], "t string, ms long").withColumn("c", T.clean_text("t")).withColumn("w", T.words("t"))
    both = [T.quality_reason(F.col("c"), F.col("w"), F.col("ms"), x).alias(n) for n, x in (("strict", True), ("lenient", False))]
    rules = {(r.t, r.ms): (r.strict, r.lenient) for r in df.select("t", "ms", *both).collect()}
    merged, rejected, turns, calls = [], [], {}, 0

    def alone(r):
        nonlocal calls
        calls += 1
        language, _, text = r[5].decode().partition("|")
        return text if language in ("en", "vi") and rules[text, r[8]][1] is None else None

    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        key = r[:4]
        calls += 1
        decodes = 1
        language, _, text = r[4].decode().partition("|")
        strict, lenient = rules[text, r[7] + r[8]]
        recovered = False
        if language in ("fail", "none") or language not in ("en", "vi"):
            reason = "failed" if language == "fail" else (text or "final-empty") if language == "none" else "unsupported-language"
        else:
            reason = strict
            if strict in recognition.REPEATS and r[7] > 0:
                decodes += 1
                solo = alone(r)
                if solo is not None:
                    text, reason, recovered = solo, None, True
            elif strict in recognition.REPEATS:
                reason = lenient
        if reason is not None:
            rejected.append((*key, reason, decodes))
            continue
        before = turns.get(key[:3], "")
        result, mode, similarity = merge_rolling(before, text)
        loose = before and mode in recognition.UNALIGNED
        if recovered:
            result, mode = (f"{before} {text}", "recovery-append-segment-only") if loose else (result, f"recovery-{mode}")
        elif loose:
            decodes += 1
            solo = alone(r)
            if solo is not None:
                text = solo
                result, mode, similarity = merge_rolling(before, solo)
                if mode == "append-unaligned":
                    result, mode = f"{before} {solo}", "append-segment-only"
                mode = f"recovery-{mode}"
        correction = "tail-rewrite" in mode and before != "" and result != before
        merged.append((*key, language, text, result, mode, round(similarity, 9), decodes, correction, not correction and ("append" in mode or mode == "initial")))
        turns[key[:3]] = result
    return sorted(merged), sorted(rejected), calls


@pytest.mark.parametrize("seed", [1, 2])
def test_final_utterances_equal_a_sequential_version(spark, tmp_path, seed):
    rows = utterances(seed)
    want, wrong, calls = plain(spark, rows)
    log = str(tmp_path / "calls")
    merged, rejects = recognition.processed(spark.createDataFrame(rows, UTTERANCES).repartition(3), model(log))
    got = sorted((*(r[c] for c in merged.columns[:8]), round(r.merge_similarity, 9), r.decodes, r.is_correction, r.is_append) for r in merged.collect())
    assert got == want
    assert sorted((r.room, r.client_id, r.turn_id, r.segment_index, r.reject_reason, r.decodes) for r in rejects.collect()) == wrong
    assert len(want) + len(wrong) == len(rows)
    modes = {x[7] for x in want}
    assert "recovery-append-segment-only" in modes and any(x[9] == 2 for x in want) and wrong
    # Nothing was decoded but what the rules asked for.
    assert sum(1 for _ in open(log)) == calls == sum(x[9] for x in want) + sum(x[5] for x in wrong)


def clips(seed, n=18):
    """(room, seq, pcm, regions, speakers): samples of one level a voice."""
    rng, rows, told = random.Random(seed), [], {}
    for i in range(n):
        size = rng.choice([20_000, 40_000, 60_000, 12_000, 17_000])
        voices = rng.sample([200, 900, 1500, 2200], rng.randint(1, 3))
        samples = np.zeros(size, "<i2")
        regions = []
        for label, level in enumerate(voices):
            for _ in range(rng.randint(1, 2)):
                a = rng.randint(-500, size - 2000)
                b = min(size + 300, a + rng.randint(1500, size))
                regions.append({"start": a, "end": b, "label": label})
                samples[max(a, 0) : b] = level
        if rng.random() < 0.2:
            regions, voices = [], voices[: rng.randint(0, 1)]
        samples[0] = i  # clips differ
        pcm = samples.tobytes()
        told[pcm] = (regions, len(voices))
        rows.append((f"room{i % 2}", i, pcm))
    return rows, told


def voices():
    """Made here, as workers don't know this module."""

    def voice(samples):
        angle = float(np.asarray(samples, float).mean()) / 700
        return [float(np.cos(angle)), float(np.sin(angle))]

    return voice


voice = voices()


def plain_reid(rows, told, failing):
    rooms, out = {}, []
    for room, i, pcm in rows:
        samples = np.frombuffer(pcm, "<i2")
        if len(samples) < 16_000:
            continue
        regions, speakers = told[pcm]
        regions = [] if i in failing else regions
        held = {}
        for r in regions:
            own = set(range(max(0, r["start"]), min(len(samples), r["end"])))
            for o in regions:
                if o["label"] != r["label"]:
                    own -= set(range(max(0, o["start"]), min(len(samples), o["end"])))
            held.setdefault(r["label"], set())
            run = []
            for x in [*sorted(own), None]:
                if run and (x is None or x != run[-1] + 1):
                    if len(run) >= 5600:
                        held[r["label"]].update(run)
                    run = []
                if x is not None:
                    run.append(x)
        usable = {label: sorted(points) for label, points in sorted(held.items()) if len(points) >= 16_000}
        state = rooms.setdefault(room, identity.Room())
        found = {label: identity.assign(state, np.float32(voice(samples[points])), 0.6, len(usable) <= 1) for label, points in usable.items()}
        if found:
            best = max(found, key=lambda x: (len(usable[x]), -x))
            d = found[best]
            out.append((room, i, d[0], f"seg-{d[1]}", "ok", [(x, len(usable[x]), found[x][0]) for x in found]))
        elif i in failing:
            out.append((room, i, None, None, "diarization-failed", []))
        elif speakers <= 1:
            d = identity.assign(state, np.float32(voice(samples)), 0.6, True)
            out.append((room, i, d[0], f"seg-fallback-{d[1]}", "whole-single-speaker", []))
        else:
            out.append((room, i, None, None, "ambiguous-overlap", []))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_diarised_clips_equal_a_sequential_version(spark, seed):
    rows, told = clips(seed)
    failing = {4}

    def diarise():
        def run(row):
            pcm = bytes(row["pcm"])
            regions, speakers = told[pcm]
            if int(np.frombuffer(pcm[:2], "<i2")[0]) in failing:
                raise ValueError("broken")
            return {"regions": regions, "speakers": speakers}

        return run

    heard = voices()
    embed = lambda: lambda row: {"v": heard(np.frombuffer(bytes(row["pcm"]), "<i2"))}
    df = spark.createDataFrame(rows, "room string, seq int, pcm binary").repartition(3)
    got = reid.reidentified(df, "room", ["seq"], diarise, embed).collect()
    seen = sorted((r.room, r.seq, r.speaker_id, r.match, r.status, [(x.label, x.clean_samples, x.speaker_id) for x in r.local]) for r in got)
    assert seen == plain_reid(rows, told, failing)
    assert {"ok", "diarization-failed"} <= {x[4] for x in seen}


def test_decisions_are_written_to_their_turns(spark):
    turns = spark.createDataFrame([("c", "t1", "text", 3), ("c", "t2", "other", 1)], "client_id string, turn_id string, canonical_text string, revision int")
    kinds = "client_id string, turn_id string, segment_index int, seq long, speaker_id string, match string, score double, second_score double, margin double, raw_best_score double, raw_second_score double, raw_margin double, audio_ms long, started_ms long, ended_ms long"
    score = (0.912345, 0.2, 0.7, 0.9, 0.2, 0.7)
    rows = [
        ("c", "t1", 1, 1, "B", "match-strong", *score, 3000, 10, 20), ("c", "t1", 0, 2, "A", "new", *score, 2000, 0, 10), ("c", "t1", 1, 3, "A", "match-soft", *score, 1000, 10, 20),
        ("c", "t1", 2, 4, "B", "match-soft", 0.5, 0.1, 0.4, 0.5, 0.1, 0.4, 3000, 20, 30), ("c", "t1", 3, 5, None, None, *[None] * 6, 9000, 30, 40), ("c", "gone", 0, 6, "A", "new", *score, 1, 0, 1),
    ]
    out = {r.turn_id: r for r in reid.with_speakers(turns, spark.createDataFrame(rows, kinds)).collect()}
    one = out["t1"]
    assert (one.speaker_id, one.speaker_status, one.revision, one.speaker_last_score, one.canonical_text) == ("A", "identified", 7, 0.5, "text")
    assert [(s.segment_index, s.speaker_id, s.match, s.score) for s in one.speaker_segments] == [(0, "A", "new", 0.9123), (1, "A", "match-soft", 0.9123), (2, "B", "match-soft", 0.5)]
    assert (out["t2"].speaker_id, out["t2"].revision, out["t2"].speaker_status) == (None, 1, None)
    assert len(out) == 2
