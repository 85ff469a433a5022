"""Parsers of landed text and JSON, and adapters that shape other tables as observations."""
