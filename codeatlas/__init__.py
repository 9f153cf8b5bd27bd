"""A PySpark-native dependency-graph analytics engine."""
