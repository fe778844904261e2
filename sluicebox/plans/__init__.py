"""Named queries, the read-only gate and result rendering."""
