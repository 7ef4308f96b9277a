"""Structured Streaming: resumable appends, running tag counts, running file metrics."""
