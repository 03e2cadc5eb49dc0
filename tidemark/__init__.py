"""A PySpark-native analytics engine for access traces."""
