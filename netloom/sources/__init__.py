"""Readers of routing dumps and topology files."""
