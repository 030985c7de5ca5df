"""Training-data operators: tokenising, chat formatting, deduplication, sharding, filtering, extraction, search, mixing."""
