"""Column functions: text, hashing, geography, vectors and identifier tokens."""
