"""A PySpark-native engine for content-addressed data, column profiles and structural diffs."""
