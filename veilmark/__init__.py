"""Spark-native operators for auditing text corpora: cleaning, evidence, weak labels, spans, calibration, risk."""
