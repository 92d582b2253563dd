"""Operators on text corpora. Nothing else in the library imports this folder."""
