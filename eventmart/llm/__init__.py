"""Training-data operators: near duplicates, fingerprints, mixing, language, personal data, tokens, packing."""
