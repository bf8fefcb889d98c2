"""Spark-native engine for multi-epoch source catalogs: cross-matching, transforms, motion fits, data cleaning."""
