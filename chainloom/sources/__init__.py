"""Sources of the chain data engine."""
