"""A Spark-native engine for document pages, box annotations, extracted records and training text."""
