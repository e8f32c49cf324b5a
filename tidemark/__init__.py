"""tidemark: a Spark-native analytics engine for coastal observation data."""
