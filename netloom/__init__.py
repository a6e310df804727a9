"""netloom: a Spark-native engine for inter-domain routing tables and AS topology."""
