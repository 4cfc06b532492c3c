"""rillwork: a PySpark-native analytics library for clickstreams and text corpora."""
