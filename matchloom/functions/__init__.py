"""Column functions: text, arrays, sequences, ranking helpers."""
