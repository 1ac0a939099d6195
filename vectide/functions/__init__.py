"""Column functions: distances, tokens, JSON values, embeddings, and their registration for SQL."""
