"""corpuscle: a PySpark-native engine for documents, transcripts and retrieval."""
