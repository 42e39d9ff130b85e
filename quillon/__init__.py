"""A PySpark-native engine for a compact SQL dialect, and operators for training data."""
