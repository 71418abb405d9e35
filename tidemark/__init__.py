"""Spark-native operators for risk analytics over survey, wearable and record tables."""
