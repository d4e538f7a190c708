"""sieveline: a PySpark-native engine for corpus curation and evaluation analytics."""
