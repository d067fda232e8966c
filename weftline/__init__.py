"""weftline: a Spark-native engine for curating and measuring language-model training data."""
