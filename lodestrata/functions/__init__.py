"""Column expressions: ids, hashes, token estimates, paths, glob predicates."""
