"""A Spark-native analytics engine for single-table SQL over CSV and Parquet."""
