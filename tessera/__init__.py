"""tessera: a Spark-native analytics engine for code estates and text corpora."""
