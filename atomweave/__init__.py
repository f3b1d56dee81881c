"""A Spark-native engine for a typed, deduplicated store of short knowledge documents."""
