"""spanloom: a PySpark-native engine for annotation, trajectory and training-data analytics."""
