"""Catalog files and undecoded lines."""
