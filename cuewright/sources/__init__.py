"""Reading and writing subtitle files, listings, logs and probe results."""
