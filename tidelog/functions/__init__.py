"""Column functions: key order, numbers, collection codecs, Bloom filters."""
