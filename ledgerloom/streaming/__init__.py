"""Streaming twins of batch operators."""
