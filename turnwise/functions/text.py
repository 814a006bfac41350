"""Text functions on columns: cleaning, words, edit rates, quality rules and the small string helpers."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import ratio


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text: Column | str) -> Column:
    """NUL becomes a space, white space of any kind is joined to one space; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)[\s\x00\x1c-\x1f]+", " "))


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def clean_bridge(text: Column | str) -> Column:
    """Tabs and newlines to spaces, spaces collapsed and trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"[\t\r\n ]+", " "))


def one_line(text: Column | str) -> Column:
    """Control characters that would end a line-protocol field become spaces."""
    return F.translate(_col(text), "\t\r\n", "   ")


def strip_prefix(text: Column | str, prefix: str) -> Column:
    """``prefix:`` taken off once from the front, spaces around it too."""
    return F.regexp_replace(_col(text), rf"^\s*{prefix}:\s*", "")


def tidy_punctuation(text: Column | str, marks: str = ",.;:!?") -> Column:
    """No white space before a punctuation mark."""
    return F.regexp_replace(_col(text), rf"\s+([{marks}])", "$1")


def punctuation_signature(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[^.,:?!]", "")


def uppercase_count(text: Column | str) -> Column:
    """Letters in upper case (title-case digraphs don't count)."""
    return F.length(F.regexp_replace(_col(text), r"\P{Lu}", ""))


def edit_rate(reference: Column | str, output: Column | str) -> Column:
    """Edit distance over the length of the reference, which counts as 1 at least."""
    reference, output = _col(reference), _col(output)
    return F.levenshtein(reference, output) / F.greatest(F.lit(1), F.length(reference))


def sanitize_translation(direction: Column | str, text: Column | str) -> Column:
    """Into Vietnamese only: tags and music signs go, no space stays before punctuation."""
    clean = clean_text(text)
    bare = F.regexp_replace(clean, r"</?\s*[A-Za-z][^>]{0,80}>", " ")
    bare = tidy_punctuation(clean_text(F.regexp_replace(bare, "[¶♩♪♫♬]+", " ")))
    return F.when(_col(direction) == "en-vi", bare).otherwise(clean)


def xml_escape(text: Column | str) -> Column:
    """Five entities, the ampersand first."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, _col(text))


def safe_name(text: Column | str, default: str, size: int = 64) -> Column:
    """Trimmed, cut to ``size``, anything but letters, digits, ``_``, ``.``, ``-`` becomes ``-``; empty gives ``default``."""
    out = F.regexp_replace(F.substring(F.trim(F.coalesce(_col(text), F.lit(""))), 1, size), r"[^A-Za-z0-9_.-]+", "-")
    return F.when(out == "", F.lit(default)).otherwise(out)


def safe_suffix(filename: Column | str, allowed: tuple[str, ...] = ("wav", "mp3", "flac", "ogg")) -> Column:
    """The file's extension if it is allowed, else ``.wav``."""
    suffix = F.lower(F.regexp_extract(_col(filename), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin(*allowed), F.concat(F.lit("."), suffix)).otherwise(F.lit(".wav"))


# --- repetition and plausibility -------------------------------------------------


def has_run(w: Column, times: int = 3) -> Column:
    """Whether some word stands ``times`` times in a row."""
    return has_repeat(w, 1, times)


def has_repeat(w: Column, span: int, times: int = 3, longest: int | None = None) -> Column:
    """Whether a block of ``span`` words (or of any number up to ``longest``) stands ``times`` times in a row.

    ``w``: words without white space. A single back reference over the joined words, in which each
    word is gone over at most once for each length of a block.
    """
    block = rf"(?<!\S)(\S++(?: \S++){{{span - 1},{(longest or span) - 1}}})(?: \1){{{times - 1}}}(?!\S)"
    return F.array_join(w, " ").rlike(block)


#: First and last code points of the scripts that neither language of the product uses (fixed values).
OTHER_SCRIPTS = (
    (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x1100, 0x11FF),
    (0x3130, 0x318F), (0xAC00, 0xD7AF), (0x0400, 0x052F), (0x0600, 0x06FF),
)
OTHER_SCRIPT_CLASS = "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in OTHER_SCRIPTS) + "]"


def has_other_script(text: Column | str) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike(OTHER_SCRIPT_CLASS)


#: Plausibility of a transcript: characters a second, least budget, words a second.
CHARS_PER_SECOND, LEAST_CHARS, WORDS_PER_SECOND = 55.0, 220, 7.0


def quality_reason(text: Column, w: Column, duration_ms: Column | None = None, repetition: bool = True) -> Column:
    """First reason to reject a transcript, or null. ``text``: cleaned; ``w``: its words, both plain columns."""
    n = F.size(w)
    out = F.when(text == "", "empty").when(has_other_script(text), "unsupported-script")
    out = out.when(F.length(F.regexp_replace(text, r"(?U)\P{IsAlphabetic}", "")) < 2, "no-lexical-content")
    if repetition:
        out = out.when(has_run(w), "consecutive-word-loop").when(has_repeat(w, 2), "repeated-bigram")
        out = out.when(has_repeat(w, 3, longest=8), "repeated-trigram")
    if duration_ms is not None:
        seconds = F.greatest(F.lit(0.45), duration_ms / 1000.0)
        known = duration_ms.isNotNull()
        out = (
            out.when(known & (F.length(text) > F.greatest(F.lit(LEAST_CHARS), F.floor(seconds * CHARS_PER_SECOND))), "implausible-length")
            .when(known & (n >= 8) & (n / seconds > WORDS_PER_SECOND), "implausible-word-rate")
            .when(known & (seconds >= 8) & (F.length(text) <= 18) & (n <= 4), "sparse-long-audio")
            .when(known & (seconds >= 12) & (F.length(text) <= 26) & (n <= 5), "sparse-very-long-audio")
        )
    return out


def most_frequent_ngram(w: Column, n: int = 3) -> Column:
    """How often the most frequent ``n``-gram of a word array occurs."""
    grams = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))
    step = lambda acc, g: F.struct(
        g.alias("last"),
        F.when(acc["last"].eqNullSafe(g), acc["run"] + 1).otherwise(1).alias("run"),
        F.greatest(acc["most"], F.when(acc["last"].eqNullSafe(g), acc["run"] + 1).otherwise(1)).alias("most"),
    )
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.when(F.size(w) < n, 0).otherwise(F.aggregate(grams, zero, step)["most"])


def distinct_ratio(w: Column) -> Column:
    return F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w))


def word_recall(source: Column, other: Column) -> Column:
    """Share of the different words of ``source`` that ``other`` has too."""
    own = F.array_distinct(source)
    return F.size(F.array_intersect(own, other)) / F.greatest(F.lit(1), F.size(own))


def translation_quality_reason(source_words: Column, output: Column, w: Column, copy_ratio: Column | None = None) -> Column:
    """First reason to reject a translation, or null. ``output`` is cleaned text, ``w`` its words."""
    n, m = F.size(w), F.size(source_words)
    out = (
        F.when(output == "", "empty")
        .when(has_other_script(output), "disallowed-script")
        .when(output.rlike(r"([<>•])(?:\s*\1){3,}"), "runaway-symbols")
        .when(has_run(w), "runaway-consecutive-word")
        .when(has_repeat(w, 2), "runaway-bigram")
        .when((n >= 9) & (most_frequent_ngram(w) >= 3), "runaway-trigram")
        .when((m > 0) & (n > F.greatest(F.lit(80), m * 5)), "runaway-length")
        .when((n >= 10) & (distinct_ratio(w) < 0.20), "runaway-repetition")
    )
    if copy_ratio is not None:
        out = out.when((m >= 8) & (n >= 8) & (copy_ratio >= 0.92), "source-copy")
    return out.when((m >= 12) & (n < F.greatest(F.lit(3), F.floor(m / 4))), "severe-undertranslation")


# --- what has no built-in function: normal form, sequence matching ------------------

ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"


def normalize(text: str, lower: bool) -> str:
    """NFC without zero-width and control characters, white space collapsed."""
    text = unicodedata.normalize("NFC", text)
    kept = []
    for c in text:
        if c in ZERO_WIDTH:
            continue
        if c.isspace():
            kept.append(" ")
        elif unicodedata.category(c) != "Cc":
            kept.append(c)
    out = " ".join("".join(kept).split())
    return out.lower() if lower else out


def match_ratio(a: list[str] | str, b: list[str] | str) -> float:
    """Twice the matched elements over all elements; 0 if either side is empty."""
    return ratio(a, b) if len(a) and len(b) else 0.0


def _vectorised(f, kind: str):
    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns, strict=True)])

    return apply


def normalize_text(text: Column | str, lower: bool = False) -> Column:
    return _vectorised(lambda t: normalize(t or "", lower), "string")(_col(text))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Match ratio of two word arrays."""
    return _vectorised(lambda x, y: match_ratio(list(x), list(y)), "double")(a, b)


#: What each part of the round trip counts.
ROUND_TRIP = {"sequence": 0.55, "recall": 0.30, "characters": 0.15}


def roundtrip_similarity(source: Column, back: Column) -> Column:
    """How alike two texts are: word sequence, share of the first one's words that the second has, and characters; 0 without words.

    Words, letters and recall are column functions; both match ratios share one call.
    """
    own, other = words(source), words(back)
    letters = lambda t: F.regexp_replace(F.lower(F.coalesce(_col(t), F.lit(""))), r"[^\p{L}\p{N}]+", "")
    recall = F.size(F.array_intersect(own, other)) / F.size(F.array_distinct(own))

    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        part = lambda x, y, z, w: ROUND_TRIP["sequence"] * match_ratio(list(x), list(y)) + ROUND_TRIP["characters"] * match_ratio(z, w)
        return pd.Series([part(*row) if len(row[0]) and len(row[1]) else 0.0 for row in zip(a, b, c, d, strict=True)], dtype=float)

    some = (F.size(own) > 0) & (F.size(other) > 0)
    return F.when(some, ratios(own, other, letters(source), letters(back)) + ROUND_TRIP["recall"] * recall).otherwise(0.0)


#: Bytes of texts whose words are found together.
_TOGETHER = 1 << 20


@cache
def _in_words() -> np.ndarray:
    """For each code point whether it is a letter or a number."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


def _runs(texts: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Of each text the number of its words, and all words with their offsets; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return _runs(pa.array([x.decode(errors="replace") for x in texts.to_pylist()], pa.large_string()))
    leads = np.flatnonzero((raw & 0xC0) != 0x80)  # the bytes that code points begin at
    begins = np.searchsorted(leads, bounds - bounds[0])  # the code points that texts begin at
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _in_words()[points]
    cut = np.zeros(len(points) + 1, bool)
    cut[begins] = True
    starts, ends = np.flatnonzero(inside[1:] & (cut | ~inside[:-1])), np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    leads = np.append(leads, len(raw))
    sizes = leads[ends] - leads[starts]
    kept = raw[np.repeat(inside[1:-1], np.diff(leads))]
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(kept))
    counts = np.diff(np.searchsorted(starts, begins))
    first = np.repeat(begins[:-1], counts)
    places = [pa.array((x - first).astype(np.int32)) for x in (starts, ends)]
    return counts, pa.StructArray.from_arrays([found, *places], ["word", "start", "end"])


def _word_offsets(texts: pa.Array) -> pa.Array:
    counts, out, at = [], [], 0
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while at < len(texts):  # about a megabyte at a time, as the numbers for it take much more
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TOGETHER, "right")))
        n, found = _runs(texts[at:upto])
        counts, out, at = [*counts, n], [*out, found], upto
    if not out:
        n, found = _runs(texts)
        counts, out = [n], [found]
    offsets = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(out))


def word_offsets(text: Column | str) -> Column:
    """(word, start, end) of each word in its own case; offsets are code points.

    Tasks look all code points of many texts up at once: a word is where letters and numbers begin and end.
    """
    return F.arrow_udf(_word_offsets, "array<struct<word:string,start:int,end:int>>")(_col(text))


def first_difference(a: Column, b: Column, shown: int = 12) -> Column:
    """``n:x|y``: where two texts first differ (code points), and what both go on with; null counts as empty."""
    from os.path import commonprefix

    def first(x: str | None, y: str | None) -> str:
        x, y = x or "", y or ""
        n = len(commonprefix([x, y]))
        return f"{n}:{x[n : n + shown]}|{y[n : n + shown]}"

    return _vectorised(first, "string")(a, b)


# --- language arbitration -----------------------------------------------------------

#: Common words of the two languages, and letters with marks.
VI_WORDS = (
    "tôi bạn anh chị em là có không và của cho một những này đó được xin chào mọi người hôm nay chúng ta sẽ đang với trong thì rất"
).split()
EN_WORDS = (
    "i you he she we they the a an is are am was were and or to of for in on with this that hello today will can not have has be"
).split()
VI_LETTERS = "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
VI_ONLY = "ăâđêôơư"


def plain_words(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits left out."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))


def repetition_penalty(w: Column) -> Column:
    """1.2 for each word that repeats the one before; more for few different words among six or more."""
    n = F.size(w)
    repeats = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(w, i) == F.get(w, i - 1)))
    few = F.size(F.array_distinct(w)) / n
    return F.when(n < 2, 0.0).otherwise(repeats * 1.2) + F.when((n >= 6) & (few < 0.45), (0.45 - few) * 8.0).otherwise(0.0)


def language_score(w: Column, language: str) -> Column:
    """How well words (``plain_words``, a plain column) fit ``vi`` or ``en``; -100 without words."""
    known = VI_WORDS if language == "vi" else EN_WORDS
    hits = F.size(F.filter(w, lambda x: x.isin(*known)))
    marked = lambda letters: F.size(F.filter(w, lambda x: x.rlike(f"[{letters}]")))
    marks = marked(VI_LETTERS) * 0.35 if language == "vi" else marked(VI_ONLY) * -1.0
    score = F.least(F.size(w), F.lit(12)) * 0.08 - repetition_penalty(w) + hits * 0.55 + marks
    return F.when(F.size(w) == 0, -100.0).otherwise(score)


def arbitrate(en_score: Column, vi_score: Column) -> Column:
    """English only if it scores higher."""
    return F.when(en_score > vi_score, "en").otherwise("vi")
