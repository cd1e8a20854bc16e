"""textloom: a PySpark-native engine for labelled text corpora."""
