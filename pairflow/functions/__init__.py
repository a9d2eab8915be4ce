"""Column functions: keys, their canonical form, partitioners."""
