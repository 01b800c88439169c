"""bindery: Spark-native analytics over digitised books and the log of the calls that made them."""
