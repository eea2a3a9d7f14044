"""Structured Streaming: ledgers of runs."""
