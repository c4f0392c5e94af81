"""Column helpers: text spans, property maps, numbers, ordered statistics."""
