"""Reproducible outputs: canonical JSON, safe CSV, checksums, content-addressed and atomic publication."""
