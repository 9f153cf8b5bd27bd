"""operators of the dependency-graph engine."""
