"""Blockchain action history on Spark: decoding, current state and history queries."""
