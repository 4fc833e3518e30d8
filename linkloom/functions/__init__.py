"""Column functions: keys, arrays, maps, hashes."""
