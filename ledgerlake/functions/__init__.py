"""Scalar functions of the chain as columns, and as functions for SQL."""
