"""Per-image work on NumPy arrays, free of Spark."""
