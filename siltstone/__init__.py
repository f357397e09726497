"""Siltstone: a metadata-driven Data Vault engine expressed as Spark DataFrames."""
