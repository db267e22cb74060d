"""Structured Streaming: maintained hits, versions, rates, fits, last positions."""
