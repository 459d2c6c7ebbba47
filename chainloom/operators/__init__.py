"""Operators of the chain data engine."""
