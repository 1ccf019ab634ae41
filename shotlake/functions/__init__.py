"""Column functions over vectors, text and media time."""
