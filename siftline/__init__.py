"""Spark-native scanning of text tables for sensitive data."""
