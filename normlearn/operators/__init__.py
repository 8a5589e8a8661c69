"""Data model and training."""
