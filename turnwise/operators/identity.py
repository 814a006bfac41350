"""Speaker identity: vectors, best and second best match, and the ordered assignment of voices to speakers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded

GALLERY, FAST, SLOW, FAST_UNTIL = 8, 0.18, 0.08, 4
#: Keys that a room's queries are dealt over.
SALTS = 16
SOFT_MARGIN, CLEAR_MARGIN, TRUSTED_MARGIN = 0.035, 0.10, 0.075


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; -1 for vectors of different length or none."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(-1.0)


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x / norm)).otherwise(v)


def similarity(v: Column, centroid: Column, gallery: Column) -> Column:
    """The best of centroid and gallery."""
    return F.greatest(dot(v, centroid), F.array_max(F.transform(gallery, lambda g: dot(v, g))))


def best_two(queries: DataFrame, speakers: DataFrame, room: str = "room") -> DataFrame:
    """For each query (``room``, id, v) the best and second speaker of its room (``room``, speaker_id, centroid), and the margin.

    Speakers of a room are few, queries may be very many: the queries of a room are dealt over
    ``SALTS`` keys, each of which has all speakers of the room, so a busy room isn't one task.
    """
    salted = queries.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    every = speakers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = salted.join(every, [room, "_salt"]).select(room, "id", "speaker_id", dot(F.col("v"), F.col("centroid")).alias("score"))
    order = Window.partitionBy(room, "id").orderBy(F.desc("score"), "speaker_id")
    ranked = pairs.withColumn("place", F.row_number().over(order)).where("place <= 2")
    at = lambda c, p: F.max(F.when(F.col("place") == p, F.col(c)))
    both = ranked.groupBy(room, "id").agg(at("speaker_id", 1).alias("best_id"), at("score", 1).alias("best"), at("score", 2).alias("second"))
    second = F.coalesce("second", F.lit(-1.0))
    return both.withColumn("second", second).withColumn("margin", F.when(F.col("second") < -0.5, 1.0).otherwise(F.col("best") - F.col("second")))


@dataclass
class Speaker:
    name: str
    centroid: np.ndarray
    gallery: list[np.ndarray] = field(default_factory=list)
    count: int = 1
    cursor: int = 0


class Rows:
    """A room's vectors of one length as rows of a matrix: which rows a speaker has, and whose a row is."""

    def __init__(self, size: int):
        self.matrix, self.owner, self.n, self.most = np.empty((64, size), np.float32), np.empty(64, np.int64), 0, 0.0
        self.own: dict[int, list[int]] = {}

    def put(self, speaker: int, place: int, x: np.ndarray) -> None:
        """``place``: 0 for the centroid, from 1 for the gallery; a speaker's places come one after another."""
        own = self.own.setdefault(speaker, [])
        if place == len(own):
            if self.n == len(self.owner):
                self.matrix, self.owner = np.concatenate([self.matrix, np.empty_like(self.matrix)]), np.concatenate([self.owner, np.empty_like(self.owner)])
            own.append(self.n)
            self.owner[self.n] = speaker
            self.n += 1
        self.matrix[own[place]] = x
        self.most = max(self.most, float(np.linalg.norm(x.astype(np.float64))))

    def nearest(self, x: np.ndarray) -> list[int] | None:
        """The speakers that can be the two best, or equal to them; None if that can't be told from these numbers."""
        with np.errstate(all="ignore"):
            rough = self.matrix[: self.n] @ x
            off = 4 * len(x) * 2.0**-23 * float(np.linalg.norm(x.astype(np.float64))) * self.most + 1e-30
        if not np.isfinite(rough).all() or not np.isfinite(off):
            return None
        rest = rough.copy()
        rest[self.own[int(self.owner[rough.argmax()])]] = -np.inf
        return np.unique(self.owner[: self.n][rough >= rest.max() - off]).tolist()


@dataclass
class Room:
    """The speakers, and their vectors by length, which are made anew from the speakers where they aren't at hand."""

    speakers: list[Speaker] = field(default_factory=list)
    rows: dict[int, Rows] | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"speakers": self.speakers, "rows": None}

    def put(self, i: int, place: int, x: np.ndarray) -> None:
        if len(x) not in self.rows:
            self.rows[len(x)] = Rows(len(x))
        self.rows[len(x)].put(i, place, x)

    def scores(self, x: np.ndarray) -> dict[int, np.float32]:
        """Scores of all speakers that can be the best or second best.

        One product finds them; their scores are then taken in double precision, vector by vector.
        """
        if self.rows is None:
            self.rows = {}
            for i, s in enumerate(self.speakers):
                for place, y in enumerate([s.centroid, *s.gallery]):
                    self.put(i, place, y)
        near = self.rows[len(x)].nearest(x) if len(x) in self.rows and len(x) else []
        if near is None:
            near = range(len(self.speakers))
        elif len(self.rows) > 1 or not len(x):
            # Vectors of another length all score the same: the first two stand for the rest.
            other = (i for i, s in enumerate(self.speakers) if len(s.centroid) != len(x) or not len(x))
            near = [*near, *islice(other, 2)]
        return {i: max([_dot(x, self.speakers[i].centroid), *(_dot(x, g) for g in self.speakers[i].gallery)]) for i in near}


def _dot(a: np.ndarray, b: np.ndarray) -> np.float32:
    return np.float32(a.astype(np.float64) @ b.astype(np.float64)) if len(a) == len(b) and len(a) else np.float32(-1)


def speaker_name(n: int) -> str:
    return f"SPEAKER_{n:02d}"


def assign(room: Room, v: Sequence[float], threshold: float = 0.60, single_soft: bool = False) -> tuple[str, str, float, float, float, float, float, float]:
    """(speaker, mode, score, second, margin, raw best, raw second, raw margin) of one voice; updates the room.

    A speaker's score is the best of its centroid and its gallery of recent voices. The first of
    equal scores wins. Only trusted matches move the centroid (a running mean) and join the gallery.
    """
    x = np.asarray(v, np.float32)
    scores = room.scores(x)
    order = sorted(scores, key=lambda i: (-scores[i], i))
    best = float(scores[order[0]]) if order else -1.0
    second = float(scores[order[1]]) if len(order) > 1 else -1.0
    margin = 0.0 if not order else 1.0 if second < -0.5 else best - second
    several = len(order) > 1
    soft, clear = max(0.35, threshold - 0.12), max(0.32, threshold - 0.20)
    mode = "new"
    if order:
        if best >= np.float32(threshold):
            mode = "match-strong"
        elif best >= np.float32(soft) and (margin >= np.float32(SOFT_MARGIN) if several else single_soft):
            mode = "match-soft"
        elif several and best >= np.float32(clear) and margin >= np.float32(CLEAR_MARGIN):
            mode = "match-clear-soft"
    if mode == "new":
        room.speakers.append(Speaker(speaker_name(len(room.speakers)), x.copy(), [x]))
        for place in (0, 1):
            room.put(len(room.speakers) - 1, place, x)
        return room.speakers[-1].name, mode, 1.0, -1.0, 1.0, best, second, margin
    s = room.speakers[order[0]]
    if best >= np.float32(threshold) or second < -0.5 or margin >= np.float32(TRUSTED_MARGIN):
        a = np.float32(FAST if s.count < FAST_UNTIL else SLOW)
        moved = (np.float32(1) - a) * s.centroid + a * x
        norm = float(np.sqrt((moved.astype(np.float64) ** 2).sum()))
        s.centroid = (moved / norm).astype(np.float32) if norm > 1e-12 else moved
        room.put(order[0], 0, s.centroid)
        if len(s.gallery) < GALLERY:
            s.gallery.append(x)
            room.put(order[0], len(s.gallery), x)
        else:
            place = s.cursor % GALLERY
            s.gallery[place] = x
            room.put(order[0], place + 1, x)
            s.cursor = (s.cursor + 1) % GALLERY
    s.count = min(s.count + 1, 1_000_000)
    return s.name, mode, best, second, margin, best, second, margin


DECISION = ["speaker_id", "match", "score", "second_score", "margin", "raw_best_score", "raw_second_score", "raw_margin"]
KINDS = "speaker_id string, match string, score double, second_score double, margin double, raw_best_score double, raw_second_score double, raw_margin double"


def assigned(voices: DataFrame, room: str | Sequence[str], order: Sequence[str], v: str = "v", threshold: float = 0.60, single_soft: bool = False) -> DataFrame:
    """Each voice's decision, voices of a room in order. A room and session should be the key, so that names start anew.

    The result depends on the order, so a room is one task; its voices are streamed through it.
    """
    rooms = [room] if isinstance(room, str) else list(room)
    kinds = dict(voices.dtypes)
    named = [c for c in order if c not in rooms]
    outputs = ", ".join([*(f"`{c}` {kinds[c]}" for c in named), KINDS])

    def one(state: Room, x: list[float], *place) -> list[tuple]:
        return [(*place, *assign(state, x, threshold, single_soft))]

    return folded(voices, rooms, order, [v, *named], Room, one, outputs)


def dominant_label(regions: DataFrame) -> DataFrame:
    """Dominant local label of each segment: (segment, label, clean_samples) → the label with most clean samples, the least of equals."""
    order = Window.partitionBy("segment").orderBy(F.desc("clean_samples"), "label")
    return regions.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
