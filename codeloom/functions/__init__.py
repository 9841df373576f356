"""Column functions: text, tokens, features, keyed hashing and fixed lookups."""
