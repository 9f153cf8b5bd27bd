"""sources of the dependency-graph engine."""
