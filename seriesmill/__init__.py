"""Metric time-series analytics as Spark DataFrame operators."""
