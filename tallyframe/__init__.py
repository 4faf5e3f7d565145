"""A Spark-native engine for document tables, reconciliation and data-quality rules."""
