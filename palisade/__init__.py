"""A Spark-native engine for code and supply-chain security analytics."""
