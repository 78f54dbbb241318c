"""Streams: debounced bursts, incremental upserts."""
