"""Training-data operators: mixing, tokens, toxicity, storage, scoring, search and deduplication."""
