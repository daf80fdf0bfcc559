"""Structured Streaming forms of the ledger, queue and duplicate checks."""
