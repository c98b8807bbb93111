"""Telemetry ingest and analysis as Spark jobs."""
