"""DataFrame operators of review analytics."""
