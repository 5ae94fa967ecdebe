"""The registered queries: library operators run on the given tables, with their SQL checks."""
