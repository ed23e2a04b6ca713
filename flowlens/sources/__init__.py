"""Sources: driver tables, adapter frames and connector-style readers/writers."""
