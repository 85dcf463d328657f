"""foliate: a PySpark-native engine for ingesting, auditing and querying document corpora."""
