"""Text rules and numbers on small examples."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.functions import numerals as N
from turnwise.functions import text as T
from turnwise.operators import align as A


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_clean_and_normal_form(spark):
    assert one(spark, T.clean_text("x"), " a\u0000 b\n c ") == "a b c"
    assert one(spark, T.clean_text("x"), None) == ""
    raw = " Xin​  chào\n\tViệt Nam﻿ "
    assert T.normalize(raw, True) == "xin chào việt nam" and T.normalize(raw, False) == "Xin chào Việt Nam"
    assert T.normalize("é\x07", False) == "é"


@pytest.mark.parametrize(
    ("words", "value"),
    [("hai nghìn mười tám", "2018"), ("mười lăm phẩy năm", "15.5"), ("triệu", "1000000"), ("hai ba trăm", "300"), ("hai ba", None), ("một triệu hai nghìn", "1002000"), ("hai nghìn ba triệu", None), ("ba mươi mốt", "31"), ("một trăm linh năm", "105"), ("phẩy năm", None), ("năm phẩy", None), ("", None)],
)
def test_numbers_in_words(words, value):
    assert N.vi_number(words.split()) == value
    assert N.vi_number("hai ba trăm".split(), lossless=True) is None


def test_percent_and_common():
    assert N.vi_percent("tăng mười lăm phần trăm") == "tăng 15%"
    assert N.vi_percent("tăng 12,5 phần trăm") == "tăng 12.5%"
    assert N.vi_percent("một trong những phần trăm") == "một trong những phần trăm"
    assert N.vi_common("năm hai nghìn mười tám") == "năm 2018"
    assert N.vi_common("khu mười hai") == "khu 12"
    assert N.vi_common("tôi mười hai tuổi") == "tôi 12 tuổi"


def test_written_forms():
    assert N.vi_written_form("việt nam có đẹp không", True) == "Việt Nam có đẹp không?"
    assert N.vi_translation_form("năm hai nghìn mười tám", True) == "Năm hai nghìn mười tám."
    assert N.vi_written_form("tôi đi nhưng anh ở", False) == "Tôi đi, nhưng anh ở"
    assert N.vi_written_form("", True) == ""


def test_english_numbers_and_anchors():
    assert N.en_number("two hundred and five thousand".split()) == 205000
    assert N.en_number(["hundred"]) is None
    assert N.numeric_anchors("15%") == [("percent", ("15",))]
    assert N.numeric_anchors("1,234") == [("integer", ("1234",))]
    assert N.numeric_anchors("3.14") == [("decimal", ("3", "14"))]
    assert N.numeric_anchors("10:30") == [("structured", ("10", "30"))]
    assert N.numeric_anchors("5‰") == [("permille", ("5",))]
    assert N.percent_anchors("fifteen percent and mười lăm phần trăm and 15%") == [("percent", ("15",))] * 3


@pytest.mark.parametrize(
    ("source", "output", "reason"),
    [("15% rồi 15%", "15%", "missing-percent-anchor"), ("in 2018", "then", "missing-numeric-anchor"), ("the NATO talks", "die Gespräche", "missing-acronym-anchor"), ("the q4 test", "ein Test 4", "missing-id-anchor"), ("the jetson board", "board", "missing-protected-term"), ("fifteen percent", "15%", None), ("plain", "text", None)],
)
def test_lost_anchors(source, output, reason):
    assert N.anchor_reason(source, output) == reason


@pytest.mark.parametrize(
    ("text", "ms", "reason"),
    [("ha ha ha", None, "consecutive-word-loop"), ("a b a b a b", None, "repeated-bigram"), ("", None, "empty"), ("a", None, "no-lexical-content"), ("one two three " * 3, None, "repeated-trigram"), ("слово одно", None, "unsupported-script"), ("x" * 400, 1000, "implausible-length"), ("a b c d e f g h", 1000, "implausible-word-rate"), ("so it is", 9000, "sparse-long-audio"), ("it is good for now ok", 13000, None), ("a fine sentence of words", 3000, None)],
)
def test_quality_reasons(spark, text, ms, reason):
    row = spark.createDataFrame([(text, ms)], "x string, ms long").select(T.clean_text("x").alias("c"), T.words("x").alias("w"), "ms")
    assert row.select(T.quality_reason(F.col("c"), F.col("w"), F.col("ms"))).first()[0] == reason


@pytest.mark.parametrize(
    ("source", "out", "reason"),
    [("a b", "", "empty"), ("a", "< < < <", "runaway-symbols"), ("a", "no no no", "runaway-consecutive-word"), ("a", "x y x y x y", "runaway-bigram"), ("one two", "a b c d a b c e a b c", "runaway-trigram"), ("a b c d e f g h i j k l", "m n", "severe-undertranslation"), ("so it is", "so ist es", None)],
)
def test_translation_reasons(spark, source, out, reason):
    row = spark.createDataFrame([(source, out)], "s string, o string").select(T.words("s").alias("sw"), T.clean_text("o").alias("o"), T.words("o").alias("w"))
    assert row.select(T.translation_quality_reason(F.col("sw"), F.col("o"), F.col("w"))).first()[0] == reason


@pytest.mark.parametrize(
    ("old", "new", "text", "mode", "ratio"),
    [
        ("", "x", "x", "initial", 1.0), ("x", "x", "x", "identical", 1.0), ("x", "", "x", "empty-window", 0.0), ("…", "a", "… a", "append-no-words", 0.0),
        ("a b c", "c d", "a b c d", "append-overlap", 0.5), ("a b c", "b c", "a b c", "overlap-only", 1.0), ("a b", "x y", "a b x y", "append-unaligned", 0.0),
        ("w1 w2 w3 w4 w5 w6", "w3 w4 w5 w6 w7", "w1 w2 w3 w4 w5 w6 w7", "tail-rewrite", 1.0),
    ],
)
def test_rolling_merge(old, new, text, mode, ratio):
    assert A.merge_rolling(old, new)[:2] == (text, mode)
    assert A.merge_rolling(old, new)[2] == pytest.approx(ratio)


def test_chunks_of_tokens():
    lengths = lambda n: [len(c) for c in A.split_chunks([str(i) for i in range(n)])]
    assert (lengths(48), lengths(60), lengths(100)) == ([48], [36, 36], [48, 48, 28])
    for n in (10, 60, 100, 200, 333):
        tokens = [f"t{i}" for i in range(n)]
        assert A.merge_chunks(A.split_chunks(tokens)) == tokens


def test_opcodes_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        codes = A.opcodes(a, b)
        assert sum(i2 - i1 for t, i1, i2, _, _ in codes if t == "equal") == best[-1][-1]
        assert [x for t, i1, i2, j1, j2 in codes for x in (b[j1:j2] if t != "delete" else [])] == b
        assert all(a[i1:i2] == b[j1:j2] for t, i1, i2, j1, j2 in codes if t == "equal")


def test_edits():
    assert A.apply_edits(["a", "b"], ["$APPEND_x", "$DELETE", "$TRANSFORM_CASE_UPPER"]) == ["x", "B"]
    assert A.apply_edits(["a", "b"], ["$KEEP", "$REPLACE_c", "$APPEND_b"]) == ["c", "b"]
    assert A.apply_edits(["well", "known"], ["$KEEP", "$MERGE_HYPHEN", "$KEEP"]) == ["well-known"]
    assert A.transform("go", "$TRANSFORM_VERB_VB_VBZ", {"go_VB_VBZ": "goes"}) == "goes"
    assert [A.transform("word", f"$TRANSFORM_CASE_{k}", {}) for k in ("CAPITAL", "CAPITAL_1", "UPPER_-1")] == ["Word", "wOrd", "WORd"]
    assert A.python_index(3, -1) == 2 and A.python_index(3, 3) is None


def test_edit_loop_ends_at_a_fixpoint_or_cycle():
    flip = lambda t: (["$KEEP", "$REPLACE_b" if t[0] == "a" else "$REPLACE_a", *["$KEEP"] * (len(t) - 1)], 1.0)
    assert A.refine(["a", "x", "y"], flip) == ["a", "x", "y"]
    assert A.refine(["a", "x"], flip) == ["a", "x"]  # too short


def test_translation_chunks_lose_nothing():
    rng = random.Random(2)
    for _ in range(50):
        text = " ".join(rng.choice(["word", "and", "end.", "so,", "x"]) for _ in range(rng.randint(0, 400)))
        chunks = A.translation_chunks(text)
        assert " ".join(chunks) == text and all(len(c.split()) <= 96 + 18 for c in chunks)
    assert A.recovery_split("a b c d and e f g") == ["a b c d", "and e f g"]
    assert A.recovery_split("a b") == []
    assert A.last_words("a b, c d", 2) == ("c d", True)


def test_roundtrip_similarity_reads_whole_turns(spark, tmp_path):
    """Turns that are alike in their first 400 characters and nowhere else."""
    from difflib import SequenceMatcher

    from turnwise.plans.text import roundtrip_similarity

    same = "alpha beta gamma " * 30
    a, b = same + "one two three four " * 20, same + "five six seven eight " * 20
    spark.createDataFrame([(1, 0, "user", a), (1, 1, "user", b)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = roundtrip_similarity(spark, str(tmp_path)).collect()
    ratio = lambda x, y: SequenceMatcher(None, x, y, autojunk=False).ratio()
    plain = 0.55 * ratio(a.split(), b.split()) + 0.30 * 3 / 7 + 0.15 * ratio(a.replace(" ", ""), b.replace(" ", ""))
    assert row.similarity == pytest.approx(plain) and row.similarity < 0.8
