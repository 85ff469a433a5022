"""Column builders and driver-side date and unit rules."""
