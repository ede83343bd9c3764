"""Training-data operators: deduplication, filtering, search, tokenisation and audit."""
