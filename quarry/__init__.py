"""quarry: a PySpark-native analytics engine for content collections."""
