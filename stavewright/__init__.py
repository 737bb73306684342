"""stavewright: a Spark-native engine for symbolic-music corpora."""
