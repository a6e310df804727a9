"""Operators on routing tables and AS topology."""
