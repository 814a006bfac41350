"""Schemas of the tables that the operators read and write. Every column is nullable; null means "not run yet"."""

from __future__ import annotations

FRAMES = "client_id string, room string, frame_no bigint, ts timestamp, pcm binary"
SPEAKER_SEGMENT = (
    "segment_index int, speaker_id string, score double, second_score double, margin double, raw_best_score double, "
    "raw_second_score double, raw_margin double, match string, audio_ms int, started_ms bigint, ended_ms bigint"
)
#: A turn: key, content, timing, state, translation, speaker.
TURNS = (
    "room string, client_id string, turn_id string, "
    "speaker string, source_language string, canonical_text string, display_text string, translation_input_text string, "
    "text string, translation string, last_window_text string, "
    "started_ms bigint, ended_ms bigint, created_at double, updated_at double, translation_updated_at double, "
    "audio_ms int, context_prefix_ms int, processing_ms int, "
    "segment_index int, segment_count int, revision int, source_revision int, is_final boolean, asr_source string, "
    "verification_status string, stability string, merge_mode string, merge_similarity double, "
    "translation_pending boolean, translation_pending_source_revision int, translation_status string, "
    "translation_language string, translation_source_text string, translation_source_revision int, "
    "translation_last_queued_words int, "
    f"speaker_id string, speaker_status string, speaker_segments array<struct<{SPEAKER_SEGMENT.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' bigint', ':bigint')}>>, "
    "speaker_last_score double, speaker_last_second_score double, speaker_last_margin double, "
    "speaker_last_raw_best_score double, speaker_last_raw_second_score double, speaker_last_raw_margin double"
)
SEGMENTS = (
    "room string, client_id string, turn_id string, segment_index int, segment_id string, started_ms bigint, "
    "ended_ms bigint, audio_ms bigint, overlap_ms bigint, context_prefix_ms bigint, avg_rms double, peak_rms double, "
    "speech_ratio double, end_reason string"
)
REJECTS = "reason string, payload string, at_ms bigint"
GOLDEN_SNIPPET = "id string, raw string, clean_lower string, normalize string, capu string"
PROBE = (
    "note string, probe_wav string, probe_source_audio string, "
    "probe_window_seconds struct<start:double,duration:double>, model_id string, provider string, raw_text string, "
    "clean_lower_text string, normalize_text string, capu_text string"
)
ASSET_LOCK = "entries array<struct<id:string,path:string,sha256:string,url:string,archive_url:string,archive_member:string>>"
TRANSCRIPTION = (
    "text string, model string, language string, duration double, processing_time double, "
    "segments array<struct<start:float,end:float,text:string>>"
)
