"""A Spark-native engine that cleans, classifies and extracts structure from messy text, one document a row."""
