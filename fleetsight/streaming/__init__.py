"""Structured Streaming jobs: ingest, live windows, de-duplication, alert state, liveness."""
