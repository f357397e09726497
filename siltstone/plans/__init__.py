"""Configuration, storage, state, scheduling, releases and whole-source loads."""
