"""The registry of queries with their SQL, and helpers around plans."""
