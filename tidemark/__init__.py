"""tidemark: Spark-native analytics for single-point flow-meter series."""
