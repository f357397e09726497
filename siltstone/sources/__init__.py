"""Staging: what is read, how much of it, and in which shape."""
