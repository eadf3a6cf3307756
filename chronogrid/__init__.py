"""PySpark-native analytics over gappy per-location time series."""
