"""A PySpark-native engine for tri-modal retrieval analytics."""
