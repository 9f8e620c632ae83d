"""A PySpark-native engine for document retrieval, evidence and training-data analytics."""
