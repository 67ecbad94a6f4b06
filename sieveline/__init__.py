"""PySpark-native engine for curating, auditing and evaluating text corpora."""
