"""Structured Streaming on top of the loads."""
