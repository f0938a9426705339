"""Readers and writers of feeds, catalogs, books, dictionaries and exports."""
