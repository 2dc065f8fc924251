"""skerry: a PySpark-native engine for retrieval experiments and corpus preparation."""
