"""Training-data operators: quality cascade, archives, tokenisation, mixing, scoring, fingerprints, near-dedup."""
