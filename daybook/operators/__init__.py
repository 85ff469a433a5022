"""Operators over daily values; each handles all stations at once."""
