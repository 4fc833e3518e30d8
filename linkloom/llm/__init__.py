"""Operators for building training corpora; nothing else in linkloom imports this package."""
