"""Streaming forms of the analyses."""
