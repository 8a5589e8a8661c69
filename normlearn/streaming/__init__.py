"""Incremental passes over arriving entity rows."""
