"""Generalized linear models over normalized data, as Spark plans."""
