"""Upkeep of a bitmap index from a stream of appended rows."""
