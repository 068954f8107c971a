"""Training-data operators: token files, fingerprints, extraction, quality, archives, BPE, secrets, mixing, joins, URL lists."""
