"""Loads, reads and checks of hubs, links and satellites, as functions of DataFrames."""
