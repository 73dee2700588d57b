"""Readers, table writers and the mapping of the given tables to the logical tables."""
