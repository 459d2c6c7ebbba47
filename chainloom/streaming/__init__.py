"""Streaming of the chain data engine."""
