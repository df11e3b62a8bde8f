"""Spark-native analytics: patient-monitoring operators and text-corpus operators."""
