"""Column functions: texts, paths, times, coordinates. All are built-in expressions."""
