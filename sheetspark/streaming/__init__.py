"""Work that arrives over time."""
