"""Readers, writers and the mapping from star tables to domain frames."""
