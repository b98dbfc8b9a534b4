"""folioflow: a PySpark-native analytics engine for text and media libraries."""
