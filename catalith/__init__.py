"""Catalith: a PySpark-native engine for multi-vendor price catalogues."""
