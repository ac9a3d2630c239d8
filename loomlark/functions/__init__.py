"""Column functions: text, time, vectors, digests, prices."""
