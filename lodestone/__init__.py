"""Lodestone: a PySpark-native engine for data quality, integration and feature preparation."""
