"""A PySpark-native engine for agent evaluations and training corpora."""
