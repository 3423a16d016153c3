"""A Spark-native engine for typed records: schemas, expressions, codecs, masks and aggregation."""
