"""Structured Streaming counterparts of the repeated runs."""
