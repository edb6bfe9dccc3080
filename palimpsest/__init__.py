"""Palimpsest: retrieval and code-memory analytics expressed as Spark plans."""
