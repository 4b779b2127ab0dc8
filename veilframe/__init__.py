"""Spark-native data anonymisation: suppression, pseudonyms, k-anonymity and differential privacy as Catalyst plans."""
