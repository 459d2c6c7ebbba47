"""Plans of the chain data engine."""
