"""tessera: a PySpark-native engine for curating, validating and scoring text and tool-call data."""
