"""newsloom: a Spark-native engine for large collections of news items and text corpora."""
