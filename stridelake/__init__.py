"""A PySpark-native engine for ordered sensor series and repeated-measures studies."""
