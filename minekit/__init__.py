"""minekit: a PySpark-native analytics and data-mining toolkit."""
