"""Training-data operators: packing, decontamination, secret scans, toxicity, near-dedup, token files, top-k, token counts, language ID and sharding."""
