"""Column functions: text, timecodes, sound keys."""
