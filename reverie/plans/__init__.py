"""Feature layers, and the wide export row."""
