"""Generic table operators. Each takes column names and constants as arguments."""
