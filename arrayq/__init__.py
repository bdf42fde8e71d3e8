"""arrayq: Spark-native reduction and quality analysis of dense numeric arrays."""
