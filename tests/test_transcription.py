"""Captures by voice activity against a plain version, and translation modes."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import boundary
from turnwise.operators import transcription

SCHEMA = "id string, part int, pcm binary, language string, vad boolean"


def transcribed(spark, rows):
    def detector():
        """The capture's first byte says which regions it has."""

        def run(row):
            kind = row["pcm"][:1]
            if kind == b"F":
                raise ValueError("no model")
            return {"regions": {b"A": [{"start": 2, "end": 4}, {"start": 0, "end": 2}, {"start": 4, "end": 99}], b"B": [{"start": 3, "end": 3}, {"start": -5, "end": 0}], b"C": None}.get(kind, [])}

        return run

    def recogniser():
        """Audio is its own text; an ``!`` fails."""

        def run(row):
            text = bytes(row["pcm"]).decode()
            if "!" in text:
                raise RuntimeError(f"cannot hear {text}")
            return {"text": None if text == "null" else text}

        return run

    got = transcription.transcribed(spark.createDataFrame(rows, SCHEMA), ["id", "part"], recogniser, detector).collect()
    return {(r.id, r.part): (r.text, [(s.start * 16000, s.end * 16000, s.text) for s in r.segments] if r.segments is not None else None, r.error) for r in got}


def test_captures_with_and_without_voice_activity(spark):
    rows = [
        ("a", 1, b"A  b    tail", "en", True),  # regions out of order, the last one held to the capture
        ("a", 2, b"B123456789", None, True),  # only empty regions
        ("b", 1, b"C123", "en", True),
        ("c", None, b"A whole", "en", False),
        (None, 3, b"null", "en", None),
        ("d", 1, b"A12!56!89", "en", True),
        ("e", 1, b"F123", "en", True),
        ("f", 1, b"F123", "en", False),
        ("g", 1, b"A   ", "en", True),
        ("h", 1, b"A1      ", "en", True),
        ("i", 1, b"", "en", False),
    ]
    got = transcribed(spark, rows)
    assert len(got) == len(rows)
    assert got["a", 1] == ("A  b tail", [(0, 2, "A  b"), (4, 6, "tail")], None)
    assert got["a", 2] == ("", None, None) and got["b", 1] == ("", None, None)
    assert got["c", None][:2] == ("A whol", None)  # whole samples
    assert got[None, 3] == ("", None, None)
    assert got["d", 1][0] is None and got["d", 1][1] is None and "A12!" in got["d", 1][2]
    assert got["e", 1][0] is None and "no model" in got["e", 1][2]
    assert got["f", 1] == ("F123", None, None)  # nobody asks the detector
    assert got["g", 1] == ("A   ", [(0, 2, "A   ")], None) and got["h", 1] == ("A1  ", [(0, 2, "A1  ")], None)
    assert got["i", 1][0] == ""


def test_no_captures(spark):
    assert transcribed(spark, []) == {}


def test_translation_modes(spark):
    def echo():
        return lambda row: {"text": f"  vi:\t{row['text']} {row['beam']} vi: x"}

    rows = spark.createDataFrame([(1, "xin chao", True, "QA"), (2, "xin chao", True, None), (3, "xin chao", False, "qa")], "id int, translation_input_text string, is_final boolean, translation_mode string")
    got = {r.id: (r.translation, r.translation_status) for r in boundary.translated(rows, echo).collect()}
    assert got == {1: ("xin chao 2 vi: x", "ok"), 2: ("xin chao 1 vi: x", "ok")}
    with pytest.raises(ValueError, match="unsupported"):
        boundary.translated(rows, echo, "en-de")
    assert boundary.translated(rows.drop("translation_mode").where(F.lit(False)), echo).count() == 0
