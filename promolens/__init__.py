"""A PySpark-native analytics engine for retail offers."""
