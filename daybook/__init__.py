"""A PySpark engine for historical daily weather observations."""
