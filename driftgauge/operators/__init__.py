"""Samplers, estimators, allocation and the online aggregator."""
