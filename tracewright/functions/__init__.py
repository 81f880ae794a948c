"""Column expressions: geometry, probability, time of day, colour."""
