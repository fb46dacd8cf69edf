"""End-to-end jobs: ingest and the user-facing reports."""
