"""Readers, writers, parameters and generators."""
