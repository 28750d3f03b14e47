"""Column functions, and functions of one file's text."""
