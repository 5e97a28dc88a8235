"""Column functions: anonymisation, hashing, keyed tokens and field encryption."""
