"""tessera: a PySpark-native engine for content-addressed data and its telemetry."""
