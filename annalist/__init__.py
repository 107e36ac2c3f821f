"""annalist: a PySpark-native engine for timeline questions over knowledge-graph dumps."""
