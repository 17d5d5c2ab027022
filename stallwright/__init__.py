"""Stallwright: a PySpark-native analytics engine for commerce catalogs and their event logs."""
