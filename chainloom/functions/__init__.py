"""Functions of the chain data engine."""
