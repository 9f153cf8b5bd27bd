"""streaming of the dependency-graph engine."""
