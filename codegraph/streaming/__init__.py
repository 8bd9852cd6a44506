"""Structured Streaming extensions (not part of the batch parity surface)."""
