"""Multi-step jobs: ingest and reports."""
