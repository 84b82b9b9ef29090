"""Column functions: sequences and text."""
