"""Messages, lines, headers and bodies that clients and workers exchange, as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, clean_text


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _or(text: Column, default: str | Column) -> Column:
    """``default`` for null and empty texts."""
    return F.when(F.coalesce(text, F.lit("")) == "", default if isinstance(default, Column) else F.lit(default)).otherwise(text)


# --- names ---------------------------------------------------------------------------


def room_name(text: Column | str, default: str = "default") -> Column:
    """Stripped, 64 characters at most, each character but letters, digits, ``.``, ``_``, ``-`` a ``-``; empty gives ``default``."""
    return F.regexp_replace(_or(F.substring(strip(_or(_col(text), default)), 1, 64), default), r"[^A-Za-z0-9._-]", "-")


def guest_name(text: Column | str, default: str = "Guest") -> Column:
    """Stripped, 64 characters at most; empty gives ``default``."""
    return _or(F.substring(strip(_or(_col(text), default)), 1, 64), default)


def language_pref(text: Column | str, known: Sequence[str] = ("vi", "en"), default: str = "vi", auto: bool = False) -> Column:
    """A known language in lower case, ``auto`` where that is allowed, else ``default``."""
    said = F.lower(strip(_or(_col(text), default)))
    return F.when(said.isin(*known, *(["auto"] if auto else [])), said).otherwise(F.lit(default))


def utterance_name(text: Column | str, fallback: Column) -> Column:
    """80 characters at most with each but letters, digits, ``_``, ``-`` a ``-``, none of them at the ends, cut to 64; empty gives ``fallback``."""
    clean = F.regexp_replace(F.substring(strip(F.coalesce(_col(text), F.lit(""))), 1, 80), r"[^A-Za-z0-9_-]", "-")
    return _or(F.substring(F.regexp_replace(clean, "^-+|-+$", ""), 1, 64), fallback)


def origin_allowed(origin: Column | str, listed: Sequence[str] = (), suffixes: Sequence[str] = (), local: bool = False, own: Column | None = None) -> Column:
    """Whether a page of this origin may call: none given, one of ``listed``, https under one of ``suffixes``, ``local`` hosts, or the server's ``own`` origin.

    Slashes at the end don't count; what is no URL is not allowed.
    """
    o = _col(origin)
    bare = F.regexp_replace(o, "/+$", "")
    host = F.lower(F.regexp_replace(F.try_parse_url(o, F.lit("HOST")), r"^\[|\]$", ""))
    rules = [bare.isin(*listed)] if listed else []
    rules += [(F.lower(F.try_parse_url(o, F.lit("PROTOCOL"))) == "https") & host.endswith(s) for s in suffixes]
    rules += [host.isin("localhost", "127.0.0.1", "::1")] if local else []
    rules += [bare == F.regexp_replace(own, "/+$", "")] if own is not None else []
    allowed = F.coalesce(o, F.lit("")) == ""
    for rule in rules:
        allowed = allowed | F.coalesce(rule, F.lit(False))
    return allowed


# --- control messages ----------------------------------------------------------------

VERBS = ("join", "language_pref", "capture_start", "capture_stop", "speech_start", "speech_end", "ping")
_CONTROL = "type string, name string, room string, language string, utterance_id string, started_ms string, client_ts string"


def control(message: Column | str, fallback_id: Column, now_ms: Column, auto: bool = False) -> Column:
    """A control message as a typed struct: verb, name, room, language, utterance_id, started_ms, client_ts.

    Names are made safe. ``language`` is null where the message has no such field, as it then changes nothing.
    What is no JSON object, and verbs that aren't known, give a null verb. ``utterance_id`` and
    ``started_ms`` of speech without any are ``fallback_id`` and ``now_ms``.
    """
    raw = _col(message)
    m = F.from_json(raw, _CONTROL)
    verb = F.when(m["type"].isin(*VERBS), m["type"])
    says = F.array_contains(F.json_object_keys(raw), "language") | verb.isin("join", "language_pref")
    speech = verb == "speech_start"
    began = F.nullif(m["started_ms"].try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(
        verb.alias("verb"), F.when(verb == "join", guest_name(m["name"])).alias("name"), F.when(verb == "join", room_name(m["room"])).alias("room"),
        F.when(says, language_pref(m["language"], auto=auto)).alias("language"), F.when(speech, utterance_name(m["utterance_id"], fallback_id)).alias("utterance_id"),
        F.when(speech, F.coalesce(began, now_ms.cast("bigint"))).alias("started_ms"), F.when(verb == "ping", m["client_ts"].try_cast("double")).alias("client_ts"),
    )


# --- lines of workers ----------------------------------------------------------------


def request_line(line: Column | str) -> Column:
    """A worker's request as a struct: mode, path, language, client_id, error.

    ``PCM`` or ``WAV``, path, language and perhaps a client, by tabs; fewer are a ``bad-request``. Older lines are
    path, language (``vi`` if there is none) and client, and mean raw samples. A null line gives nulls.
    """
    f = F.split(_col(line), "\t", -1)
    at = lambda i: F.get(f, F.lit(i))
    new = at(0).isin("PCM", "WAV")
    bad = new & (F.size(f) < 3)
    said = lambda i, none: F.coalesce(strip(at(i)), F.when(f.isNotNull(), F.lit(none)))
    pick = lambda a, b: F.when(~bad, F.when(new, a).otherwise(b))
    return F.struct(
        pick(F.lower(at(0)), F.when(f.isNotNull(), F.lit("pcm"))).alias("mode"), pick(at(1), at(0)).alias("path"),
        pick(F.lower(said(2, "")), F.lower(said(1, "vi"))).alias("language"), pick(said(3, ""), said(2, "")).alias("client_id"), F.when(bad, "bad-request").alias("error"),
    )


def recogniser_reply(reply: Column | str) -> Column:
    """A recogniser's reply as a struct: ok, language, text, reason, decode_mode.

    ``ERR`` and ``SKIP`` give their reason; ``OK``, language, text and perhaps a mode; older replies are language and text.
    Without text it isn't ok; the reason is then ``empty``. Anything else, also null, is an ``invalid-reply``.
    """
    r = _col(reply)
    f, two = F.split(r, "\t", 4), F.split(r, "\t", 2)
    head = F.get(f, F.lit(0))
    tabbed = F.coalesce(F.size(f) >= 2, F.lit(False))
    refused = tabbed & head.isin("ERR", "SKIP")
    new = tabbed & (head == "OK")
    read = tabbed & ~refused & ~(new & (F.size(f) < 3))
    text = F.when(read, clean_text(F.when(new, F.get(f, F.lit(2))).otherwise(F.get(two, F.lit(1))))).otherwise("")
    language = F.when(read, F.lower(strip(F.when(new, F.get(f, F.lit(1))).otherwise(head)))).otherwise("")
    told = _or(F.get(two, F.lit(1)), F.when(head == "ERR", "worker-error").otherwise("worker-skip"))
    reason = F.when(refused, told).when(~read, "invalid-reply").when(text == "", "empty")
    return F.struct((read & (text != "")).alias("ok"), language.alias("language"), text.alias("text"), reason.alias("reason"), F.when(new, F.lower(strip(F.get(f, F.lit(3))))).alias("decode_mode"))


# --- bodies and headers --------------------------------------------------------------


def response_body(kind: Column, text: Column, language: Column, duration: Column, segments: Column | None = None) -> Column:
    """The body of a transcription: the bare text, verbose JSON or JSON, by ``kind`` (``text``, ``verbose_json``, anything else).

    ``segments``: array of (start, end, text), numbered from ``segment_0``; null leaves them out. The seconds used are the
    duration, rounded half up.
    """
    parts = [F.lit("transcribe").alias("task"), language.alias("language"), duration.alias("duration"), text.alias("text")]
    if segments is not None:
        each = lambda s, i: F.struct(F.concat(F.lit("segment_"), i.cast("string")).alias("id"), F.lit("transcript.text.segment").alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))
        parts.append(F.transform(segments, each).alias("segments"))
    used = F.struct(F.lit("duration").alias("type"), F.round(duration).cast("bigint").alias("seconds"))
    verbose = F.to_json(F.struct(*parts, used.alias("usage")))
    return F.when(kind == "text", text).when(kind == "verbose_json", verbose).otherwise(F.to_json(F.struct(text.alias("text"))))


_WEIGHT = r"^q=([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"


def prefers(header: Column | str, family: str = "vi", other: str = "en") -> Column:
    """Whether a weighted list of languages asks for ``family`` at least as much as for ``other``.

    A language weighs 1 where its first parameter is no weight; a family counts by its heaviest; null and empty lists ask for nothing.
    """
    parts = F.transform(F.split(F.coalesce(_col(header), F.lit("")), ","), lambda p: F.split(p, ";"))

    def weight(name: str) -> Column:
        own = F.filter(parts, lambda p: F.lower(F.trim(p[0])).startswith(name))
        given = F.transform(own, lambda p: F.coalesce(F.nullif(F.regexp_extract(F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))), _WEIGHT, 1), F.lit("")).cast("double"), F.lit(1.0)))
        return F.array_max(F.transform(given, lambda q: F.greatest(q, F.lit(0.0))))

    return F.coalesce(weight(family) >= F.coalesce(weight(other), F.lit(0.0)), F.lit(False))


# --- errors --------------------------------------------------------------------------

# Code, what the message holds, English text (None: the message itself), Vietnamese text ({} is what follows the mark), mark.
ERRORS = (
    ("model_required", ("model is required",), 'Parameter "model" is required.', 'Tham số "model" là bắt buộc.', None),
    ("file_required", ("multipart field 'file' is required",), "Multipart form field 'file' is required.", "Trường dữ liệu 'file' trong yêu cầu multipart là bắt buộc.", None),
    ("audio_too_long", ("audio duration exceeds",), None, "Thời lượng âm thanh vượt quá giới hạn {} giây.", "exceeds "),
    ("model_not_found", ("unknown model id:",), None, "Không tìm thấy model với mã ID: {}.", "unknown model id: "),
    ("ffmpeg_not_found", ("ffmpeg not found",), "FFmpeg is not installed on the server. Please install it: `brew install ffmpeg` (macOS), `apt install ffmpeg` (Linux), or download from https://ffmpeg.org/download.html",
     "Không tìm thấy FFmpeg trên máy chủ. Vui lòng cài đặt FFmpeg: `brew install ffmpeg` (macOS), `apt install ffmpeg` (Linux), hoặc tải từ https://ffmpeg.org/download.html", None),
    ("ffmpeg_launch_failed", ("failed to launch ffmpeg",), "Failed to launch FFmpeg. Please check your FFmpeg installation and execution permissions.", "Không thể khởi chạy FFmpeg. Vui lòng kiểm tra cài đặt FFmpeg và quyền thực thi.", None),
    ("audio_decode_failed", ("failed to decode", "ffmpeg failed", "hound error", "wav"), "Failed to decode uploaded audio. Please check file format.", "Giải mã âm thanh thất bại. Vui lòng kiểm tra định dạng tệp tin.", None),
    ("capu_unavailable", ("CAPU runtime unavailable",), None, "Trình chạy hậu kỳ CAPU không khả dụng: {}.", "CAPU runtime unavailable: "),
    ("capu_timeout", ("CAPU request timed out",), None, "Yêu cầu hậu kỳ CAPU đã hết thời gian chờ: {}.", "CAPU request timed out: "),
    ("capu_failed", ("CAPU request failed",), None, "Yêu cầu hậu kỳ CAPU thất bại: {}.", "CAPU request failed: "),
    ("invalid_multipart", ("failed to parse multipart",), "Failed to parse multipart transcription request.", "Không thể phân tích yêu cầu transcription multipart.", None),
    ("inference_failed", ("inference failed",), "Transcription inference failed.", "Nhận dạng giọng nói thất bại.", None),
)
TOO_LARGE = (
    "Request body exceeds the configured limit of {} MB. Reduce the upload size or raise `max_upload_mb` in `config/runtime.toml` and restart the server.",
    "Dung lượng yêu cầu vượt quá giới hạn {} MB. Vui lòng giảm kích thước tệp tin hoặc tăng giới hạn `max_upload_mb` trong `config/runtime.toml` rồi khởi động lại máy chủ.",
)
INTERNAL = "Lỗi máy chủ nội bộ: {}."


def upload_limit(message: Column | str) -> Column:
    """The limit in MB that a message names as exceeded; null if none."""
    return F.regexp_extract(F.coalesce(_col(message), F.lit("")), r"request body exceeds max_upload_mb = \s*\+?([0-9]+)(?:\s|$)", 1).try_cast("bigint")


def _fill(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def localised_error(message: Column | str, vietnamese: Column) -> Column:
    """A struct of code and message in the reader's language; the first of ERRORS that fits, else ``internal_error``. Null counts as empty."""
    m = F.coalesce(_col(message), F.lit(""))
    limit = upload_limit(m)
    code = F.when(limit.isNotNull(), "request_too_large")
    english = F.when(limit.isNotNull(), _fill(TOO_LARGE[0], limit.cast("string")))
    local = F.when(limit.isNotNull(), _fill(TOO_LARGE[1], limit.cast("string")))
    for name, marks, en, vi, mark in ERRORS:
        fits = F.lit(False)
        for x in marks:
            fits = fits | m.contains(x)
        told = F.lit(vi)
        if mark is not None:
            rest = F.coalesce(F.get(F.split(m, mark, -1), F.lit(1)), F.lit(""))
            told = _fill(vi, F.split_part(rest, F.lit(" seconds"), F.lit(1)) if name == "audio_too_long" else rest)
        code, english, local = code.when(fits, name), english.when(fits, m if en is None else F.lit(en)), local.when(fits, told)
    return F.struct(code.otherwise("internal_error").alias("code"), F.when(F.coalesce(vietnamese, F.lit(False)), local.otherwise(_fill(INTERNAL, m))).otherwise(english.otherwise(m)).alias("message"))


def decode_error(message: Column | str) -> Column:
    """Status and class of an error in reading audio: the server's fault where the decoder is missing, else the request's."""
    m = F.coalesce(_col(message), F.lit(""))
    own = m.contains("ffmpeg not found") | m.contains("failed to launch ffmpeg")
    return F.struct(F.when(own, 500).otherwise(400).alias("status"), F.when(own, "server_error").otherwise("invalid_request_error").alias("error_type"))


def runtime_error(message: Column | str) -> Column:
    """Status and class of an error while at work: 504 for a post-processor that timed out, else 500."""
    late = F.coalesce(_col(message), F.lit("")).contains("CAPU request timed out")
    return F.struct(F.when(late, 504).otherwise(500).alias("status"), F.lit("server_error").alias("error_type"))


# --- what clients show ---------------------------------------------------------------


def segment_state(status: Column, stability: Column, is_final: Column) -> Column:
    """corrected, uncertain, verified or provisional: a correction first, then what is verified or final, then what is uncertain. Nulls count as empty and not final."""
    s, kind = F.coalesce(status, F.lit("")), F.coalesce(stability, F.lit(""))
    settled = (kind == "verified") | F.coalesce(is_final, F.lit(False))
    doubt = s.contains("unresolved") | s.contains("uncertain")
    return F.when(s.contains("corrected-right-context"), "corrected").when(settled & doubt, "uncertain").when(settled, "verified").when(kind == "uncertain", "uncertain").otherwise("provisional")


def word_starts(ids: Column) -> Column:
    """Places (from 0) of an array of word ids where a new word begins: the first one, and any whose id differs from the one before; null equals null, and no ids give 0."""
    before = F.slice(F.concat(F.slice(ids, 1, 1), ids), F.lit(1), F.size(ids))
    new = F.zip_with(ids, before, lambda a, b: ~a.eqNullSafe(b))
    found = F.filter(F.transform(new, lambda x, i: F.when(x | (i == 0), i)), lambda i: i.isNotNull())
    return F.when(F.size(ids) > 0, found).otherwise(F.array(F.lit(0)))


def _decimals(x: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", x.cast("double"))


def _quoted(x: Column) -> Column:
    return F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)


def speakers_body(speakers: Column, dominant: Column, regions: Column, locals_: Column, rate: int = 16_000, engine: str = "seg-reid-v1") -> Column:
    """A diarised clip as JSON with fixed decimals.

    ``regions``: array of (start, end, label), in samples; ``locals_``: array of (label, clean_samples, speaker_id, match, score,
    raw_best, raw_second, raw_margin). Labels without a speaker are ``UNKNOWN`` and have no scores.
    """
    known = F.map_from_entries(F.transform(F.filter(locals_, lambda x: x["speaker_id"].isNotNull()), lambda x: F.struct(x["label"], x["speaker_id"])))
    who = lambda x: _quoted(F.coalesce(x, F.lit("UNKNOWN")))
    seconds = lambda x: _decimals(x / F.lit(float(rate)), 3)
    region = lambda r, of: F.concat(F.lit('{"start":'), seconds(r["start"]), F.lit(',"end":'), seconds(r["end"]), F.lit(',"local":'), r["label"].cast("string"), F.lit(',"speaker_id":'), who(F.element_at(of, r["label"])), F.lit("}"))

    def local(x: Column) -> Column:
        scores = F.concat(
            F.lit(',"score":'), _decimals(x["score"], 4), F.lit(',"match":'), _quoted(x["match"]), F.lit(',"raw_best":'), _decimals(x["raw_best"], 4),
            F.lit(',"raw_second":'), _decimals(x["raw_second"], 4), F.lit(',"raw_margin":'), _decimals(x["raw_margin"], 4),
        )
        ms = F.floor(x["clean_samples"] * 1000 / rate).cast("string")
        head = F.concat(F.lit('{"local":'), x["label"].cast("string"), F.lit(',"clean_ms":'), ms, F.lit(',"speaker_id":'), who(x["speaker_id"]))
        return F.concat(head, F.when(x["speaker_id"].isNotNull(), scores).otherwise(""), F.lit("}"))

    return F.concat(
        F.lit(f'{{"engine":"{engine}","diarized_speakers":'), speakers.cast("string"), F.lit(',"dominant":'), who(dominant),
        F.lit(',"regions":['), F.transform(F.array(known), lambda of: F.array_join(F.transform(regions, lambda r: region(r, of)), ","))[0], F.lit('],"locals":['), F.array_join(F.transform(F.array_sort(locals_), local), ","), F.lit("]}"),
    )
