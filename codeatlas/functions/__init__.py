"""functions of the dependency-graph engine."""
