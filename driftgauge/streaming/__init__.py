"""Answers that grow while they are watched: the online aggregator's rounds."""
