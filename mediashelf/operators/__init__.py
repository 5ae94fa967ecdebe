"""DataFrame operators on documents and stored tables."""
