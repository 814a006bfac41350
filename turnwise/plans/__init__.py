"""The queries, by family. Importing this package registers them."""

from . import boundaries, conversation, intervals, measures, pipeline, previews, protocol, recognition, sessions, streams, text, transcription

__all__ = ["boundaries", "conversation", "intervals", "measures", "pipeline", "previews", "protocol", "recognition", "sessions", "streams", "text", "transcription"]
