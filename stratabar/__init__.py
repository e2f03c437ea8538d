"""A PySpark-native engine for market trades and candles."""
