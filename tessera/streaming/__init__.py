"""Incremental forms: a stream of documents against a fixed evaluation table, and logs appended by key."""
