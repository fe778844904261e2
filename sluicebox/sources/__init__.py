"""Readers and writers: commit logs, diffs, sessions, reports, event streams."""
