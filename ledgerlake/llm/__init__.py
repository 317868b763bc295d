"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, and it can be removed as a
whole (together with ``corpus_pipeline.py`` and ``tests/llm``).
"""
