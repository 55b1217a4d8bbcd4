"""Readers and writers: text tree, JSON forms, listings, constraints, index records."""
