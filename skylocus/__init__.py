"""Spark-native analytics for crowdsourced Wi-Fi location data."""
