"""Artifacts: transcripts, JSON lines, training JSON, metrics, tables, and the scan of transcripts back."""
