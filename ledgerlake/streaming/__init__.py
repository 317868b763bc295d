"""Continuous ingest into the chain's tables."""
