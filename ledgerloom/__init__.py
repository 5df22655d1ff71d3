"""A PySpark-native engine for facts that carry their provenance."""
