"""Chronoloom: versioned, bi-temporal data processing expressed as Spark plans."""
