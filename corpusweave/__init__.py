"""corpusweave: a Spark-native engine that builds, indexes and queries a text corpus."""
