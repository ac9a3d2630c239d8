"""Training-data operators: packing, mixing, near-dedup, chat, scoring, secrets, search, counts, quality."""
