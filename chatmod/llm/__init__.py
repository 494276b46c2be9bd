"""Operators for a training-data pipeline: deduplication, language, decontamination, sharding,
token output, toxicity, byte-pair encoding and personal data. Nothing else in the library imports this."""
