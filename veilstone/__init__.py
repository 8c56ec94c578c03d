"""Sensitive-data detection, scoring, suppression, reporting and redaction as Spark plans."""
