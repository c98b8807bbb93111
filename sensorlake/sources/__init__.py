"""Readers: lake tables, message streams, landed text and documents."""
