"""Column functions on labels and series."""
