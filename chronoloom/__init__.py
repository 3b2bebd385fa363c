"""A PySpark-native engine for causal time-series features and large-scale tables."""
