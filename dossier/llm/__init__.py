"""Training-data operators: deduplication, scoring, tokens, filters and decontamination for large text tables."""
