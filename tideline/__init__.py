"""A Spark-native change-data-capture engine: DataFrame plans over ordered change logs."""
