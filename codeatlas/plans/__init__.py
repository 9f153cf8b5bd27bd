"""plans of the dependency-graph engine."""
