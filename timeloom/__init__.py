"""timeloom: a Spark-native engine for time-aligned media metadata and text corpora."""
