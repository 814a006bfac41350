"""Voice activity: frames into segments and turns, as one fold that batch and streaming share.

The fold takes a state and one frame and gives segments. Frames are ordered by (time, number);
their time is that of the frame's end. Levels are given; bytes are counted, not carried.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audio import BYTES_PER_SECOND, FRAME_BYTES, FRAME_MS, RATE
from .folds import folded


@dataclass(frozen=True)
class Limits:
    """Constants of the behaviour (fixed values)."""

    preroll: int = 30
    onset: int = 4
    hangover: int = 35
    soft_silence: int = 16
    floor: float = 0.006
    multiplier: float = 2.4
    peak: float = 0.012
    peak_factor: float = 1.45
    most_noise: float = 0.0065
    soft_bytes: int = 8 * BYTES_PER_SECOND
    hard_bytes: int = 12 * BYTES_PER_SECOND
    overlap_bytes: int = 800 * BYTES_PER_SECOND // 1000
    least_bytes: int = 250 * BYTES_PER_SECOND // 1000
    turn_gap_ms: int = 1500
    context_bytes: int = 10 * BYTES_PER_SECOND
    window_bytes: int = 24 * BYTES_PER_SECOND


LIMITS = Limits()


def threshold(noise: Column, limits: Limits = LIMITS) -> Column:
    return F.greatest(F.lit(limits.floor), noise * limits.multiplier)


def speech_like(rms: Column, peak: Column, noise: Column, limits: Limits = LIMITS) -> Column:
    least = threshold(noise, limits)
    return (rms >= least) & (peak >= F.greatest(F.lit(limits.peak), least * limits.peak_factor))


@dataclass
class State:
    noise: float = 0.003
    pending_noise: float = 0.0
    onset: int = 0
    silent: int = 0
    preroll: deque = field(default_factory=deque)
    active: bool = False
    turn: int = 0
    index: int = 0
    last_end: int = -1
    started: int = 0
    size: int = 0
    leading: int = 0
    frames: int = 0
    rms_sum: float = 0.0
    peak: float = 0.0
    like: int = 0
    context: int = 0
    recent: deque = field(default_factory=deque)


def _is_speech(state: State, rms: float, peak: float, limits: Limits) -> tuple[bool, float]:
    least = max(limits.floor, state.noise * limits.multiplier)
    return rms >= least and peak >= max(limits.peak, least * limits.peak_factor), least


def _count(state: State, rms: float, peak: float, like: bool) -> None:
    state.size += FRAME_BYTES
    state.frames += 1
    state.rms_sum += rms
    state.peak = max(state.peak, peak)
    state.like += like
    state.recent.append((rms, peak))


def _flush(state: State, now: int, reason: str, overlap: bool, limits: Limits) -> Iterator[tuple]:
    """Ends the running segment; one that is too short gives nothing."""
    if state.size < limits.least_bytes:
        state.active = False
        return
    novel = state.size - min(state.leading, state.size) or state.size
    context = min(state.context, limits.context_bytes, max(0, limits.window_bytes - novel))
    frames = max(1, state.frames)
    ms = lambda n: n * 1000 // BYTES_PER_SECOND
    yield (
        state.turn, state.index, state.started, now, ms(novel), ms(state.size - novel), ms(context),
        state.rms_sum / frames, state.peak, min(1.0, state.like / frames), reason,
    )
    state.context = min(limits.context_bytes, state.context + novel)
    state.last_end = now
    state.index += 1
    carried = min(state.size, limits.overlap_bytes) if overlap else 0
    state.active, state.size, state.leading = overlap, carried, carried
    state.frames = state.like = 0
    state.rms_sum = state.peak = 0.0
    kept = carried // FRAME_BYTES
    while len(state.recent) > kept:
        state.recent.popleft()
    if overlap:
        # The carried frames count in the next segment too, all of them as speech.
        state.started = now - ms(carried)
        mean = (sum(r * r for r, _ in state.recent) / max(1, kept)) ** 0.5
        state.frames = state.like = max(1, kept)
        state.rms_sum, state.peak = mean * state.frames, max((p for _, p in state.recent), default=0.0)


def step(state: State, now: int, rms: float, peak: float, limits: Limits = LIMITS) -> Iterator[tuple]:
    """One frame of 20 ms that ended at ``now`` (ms)."""
    if not state.active and state.pending_noise > state.noise:
        state.noise, state.pending_noise = min(limits.most_noise, state.pending_noise), 0.0
    like, least = _is_speech(state, rms, peak, limits)
    state.preroll.append((rms, peak))
    if len(state.preroll) > limits.preroll:
        state.preroll.popleft()
    if not state.active:
        if rms < least:
            state.noise = max(0.001, state.noise * 0.985 + rms * 0.015)
        state.onset = state.onset + 1 if like else 0
        if state.onset < limits.onset:
            return
        if state.last_end < 0 or now - state.last_end > limits.turn_gap_ms:
            state.turn, state.index, state.context = state.turn + 1, 0, 0
        state.active, state.onset, state.silent = True, 0, 0
        state.started = now - len(state.preroll) * FRAME_MS
        state.size = state.leading = state.frames = state.like = 0
        state.rms_sum = state.peak = 0.0
        state.recent.clear()
        for r, p in state.preroll:
            _count(state, r, p, _is_speech(state, r, p, limits)[0])
        state.preroll.clear()
        return
    _count(state, rms, peak, like)
    if state.size >= limits.hard_bytes:
        yield from _flush(state, now, "hard-cut", True, limits)
    state.silent = 0 if like else state.silent + 1
    soft = state.size >= limits.soft_bytes and state.silent >= limits.soft_silence
    if soft or state.silent >= limits.hangover:
        yield from _flush(state, now, "soft-silence" if soft else "silence", False, limits)
        state.silent = 0
        state.preroll.clear()


def finish(state: State, now: int, limits: Limits = LIMITS) -> Iterator[tuple]:
    """The end of the capture: what runs becomes a segment."""
    if state.active:
        yield from _flush(state, now, "capture-stop", False, limits)


#: Rejections that tell of noise, the least length of such a segment, the share of its level that is learned.
NOISE_REASONS = {"empty", "empty-transcript", "vit-final-empty", "sparse-long-audio", "sparse-very-long-audio", "sparse-unconfirmed-preview", "sparse-preview-mismatch"}
NOISE_LEAST_MS, NOISE_SHARE = 1800, 0.35


def learn_noise(state: State, audio_ms: int, avg_rms: float, reason: str, limits: Limits = LIMITS) -> None:
    """A rejected segment that was long raises the noise floor from the next idle frame on."""
    target = min(limits.most_noise, max(0.001, avg_rms * NOISE_SHARE))
    if audio_ms >= NOISE_LEAST_MS and reason in NOISE_REASONS:
        state.pending_noise = max(state.pending_noise, target if target > state.noise else 0.0)


COLUMNS = ["turn_no", "segment_index", "started_ms", "ended_ms", "audio_ms", "overlap_ms", "context_prefix_ms", "avg_rms", "peak_rms", "speech_ratio", "end_reason"]
KINDS = "turn_no int, segment_index int, started_ms long, ended_ms long, audio_ms long, overlap_ms long, context_prefix_ms long, avg_rms double, peak_rms double, speech_ratio double, end_reason string"


#: What a judge of segments gets, and gives: the reason to reject one, or None.
Judge = Callable[[dict], str | None]


def judged(state: State, found: Iterator[tuple], judge: Judge | None, limits: Limits = LIMITS) -> Iterator[tuple]:
    """``found`` as it is, each judged as soon as it ends: a rejected one raises the noise floor of what follows."""
    for segment in found:
        if judge is not None:
            row = dict(zip(COLUMNS, segment, strict=True))
            reason = judge(row)
            if reason:
                learn_noise(state, row["audio_ms"], row["avg_rms"], reason, limits)
        yield segment


def segments(frames: DataFrame, key: str | Sequence[str] = "client_id", limits: Limits = LIMITS, judge: Judge | None = None) -> DataFrame:
    """Segments of each capture's frames (``key``: one column or several, ts_ms, frame_no, rms, peak).

    A capture (see ``lifecycle.numbered_captures``) ends with a flush. ``judge`` is asked of each
    segment, in a Python worker. Frames are streamed, so a capture may be of any length.
    """

    def one(held: list, now: int, rms: float, peak: float) -> Iterator[tuple]:
        held[1] = now
        return judged(held[0], step(held[0], now, rms, peak, limits), judge, limits)

    def end(held: list) -> Iterator[tuple]:
        return judged(held[0], finish(held[0], held[1], limits), judge, limits)

    keys = [key] if isinstance(key, str) else list(key)
    return folded(frames, keys, ["ts_ms", "frame_no"], ["ts_ms", "rms", "peak"], lambda: [State(), 0], one, KINDS, end)


#: Samples that a detector gets at a time, and the silence put before a file: half a second, in whole steps (fixed values).
STEP_SAMPLES = 512
PAD_SAMPLES = int(0.5 * RATE) // STEP_SAMPLES * STEP_SAMPLES


def file_segments(files: DataFrame, key: str, build: Callable[[], Callable[[np.ndarray], bool]]) -> DataFrame:
    """key, start_s, end_s, pcm of the speech in whole files (key, pcm), by an injected detector.

    The detector gets 512 samples at a time (floats from -1 to 1), whole steps only, after a lead of
    silence that lets it settle, and says whether they are speech; the runs of steps that are become
    segments. Starts are corrected by the lead and never below 0. Null and too short files have none.
    """
    kind = dict(files.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = build()
        for batch in batches:
            out = []
            for name, pcm in zip(batch[key], batch["pcm"], strict=True):
                samples = np.frombuffer(bytes(pcm or b"")[: len(pcm or b"") // 2 * 2], "<i2")
                padded = np.concatenate([np.zeros(PAD_SAMPLES, "<i2"), samples])
                steps = padded[: len(padded) // STEP_SAMPLES * STEP_SAMPLES].reshape(-1, STEP_SAMPLES)
                speech = np.array([False, *(bool(detect(s.astype(np.float32) / 32768)) for s in steps), False])
                edges = np.flatnonzero(speech[1:] != speech[:-1]) * STEP_SAMPLES
                for start, end in edges.reshape(-1, 2):
                    start_s = max(0.0, (start - PAD_SAMPLES) / RATE)
                    out.append((name, start_s, start_s + (end - start) / RATE, padded[start:end].tobytes()))
            yield pd.DataFrame(out, columns=[key, "start_s", "end_s", "pcm"])

    return files.select(key, "pcm").mapInPandas(work, f"{key} {kind}, start_s double, end_s double, pcm binary")


def noise_floors(frames: DataFrame, key: str, order: Sequence[str], start: float = 0.003, limits: Limits = LIMITS) -> DataFrame:
    """key, noise_floor: the floor after all of a key's idle levels (rms) in order; a recursive mean, so a fold and no window."""

    def learn(held: list, rms: float) -> tuple:
        if rms < max(limits.floor, held[0] * limits.multiplier):
            held[0] = max(0.001, held[0] * 0.985 + rms * 0.015)
        return ()

    return folded(frames, [key], order, ["rms"], lambda: [start], learn, "noise_floor double", lambda held: [(held[0],)])
