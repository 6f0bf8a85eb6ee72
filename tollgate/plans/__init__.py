"""Query plans: the registry of named queries and their SQL oracles."""
