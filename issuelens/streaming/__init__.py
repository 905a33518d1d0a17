"""Structured Streaming forms of the log-shaped operators: additions, since the batch forms are complete without them."""
