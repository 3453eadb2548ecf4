"""Training-data operators: packing, extraction, filtering, near-duplicate search, tokens, chat."""
