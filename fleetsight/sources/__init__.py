"""Readers, sinks and the adapter from the star-schema tables to telemetry."""
