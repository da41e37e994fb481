"""luminal: a PySpark-native data-mapping and spatial analytics engine."""
