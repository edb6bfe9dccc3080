"""Registered queries: operators applied to the project's tables, and their SQL."""
