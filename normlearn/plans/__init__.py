"""Plans of one loss and gradient pass."""
