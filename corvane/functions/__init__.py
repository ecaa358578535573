"""Column functions: geometry of boxes and polygons, keys from file names, hashes."""
