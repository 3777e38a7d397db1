"""Structured Streaming versions of ingest (I7) and triage."""

from postrisk.streaming.ingest import stream_ingest
from postrisk.streaming.triage import stream_triage

__all__ = ["stream_ingest", "stream_triage"]
