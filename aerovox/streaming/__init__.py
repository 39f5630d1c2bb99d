from aerovox.streaming.incremental import (
    LiveView,
    incremental_conversation_stats,
    incremental_flight_stats,
    incremental_transcript_by_speaker,
)
from aerovox.streaming.ingest import (
    POLL_SPACING,
    QUALITY_METRICS,
    append_stream,
    finish,
    ingest_flights,
    ingest_rejected_polls,
    ingest_rejected_utterances,
    ingest_transcripts,
    resume_point,
    take_stream,
    taken,
)
from aerovox.streaming.packed import PackedTable
from aerovox.streaming.summary import observed_breaches, stream_summary

__all__ = [
    "POLL_SPACING",
    "QUALITY_METRICS",
    "LiveView",
    "PackedTable",
    "append_stream",
    "finish",
    "incremental_conversation_stats",
    "incremental_flight_stats",
    "incremental_transcript_by_speaker",
    "ingest_flights",
    "ingest_rejected_polls",
    "ingest_rejected_utterances",
    "ingest_transcripts",
    "observed_breaches",
    "resume_point",
    "stream_summary",
    "take_stream",
    "taken",
]
