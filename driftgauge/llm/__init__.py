"""Operators for large-scale training-data preparation.

Nothing outside this package imports it; ``driftgauge.llm.registry`` lists its
queries.
"""
