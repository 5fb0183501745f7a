"""Spark-native similarity analytics in metric spaces."""
