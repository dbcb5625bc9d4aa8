"""Readers, writers and the adapters that derive log tables from given ones."""
