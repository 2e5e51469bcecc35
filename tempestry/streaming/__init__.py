"""Structured Streaming: windowed counts, sessions, interval joins and keyed state, with the same formulas as in batch."""
