"""quirework: a PySpark-native engine from paged documents to instruction datasets."""
