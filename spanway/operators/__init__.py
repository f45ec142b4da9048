"""Operators on event tables; every one builds a lazy plan."""
