"""loomlark: a PySpark-native analytics engine for session logs and training data."""
