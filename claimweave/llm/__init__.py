"""Training-data operators: tokenising, formatting, filtering, packing, near duplicates, search and scoring."""
