"""Scalar functions, column types, names and expression macros."""
