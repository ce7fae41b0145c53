"""A Spark-native engine for labelled time series."""
