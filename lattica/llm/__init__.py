"""Operators that prepare training text: cleaning, deduplication, mixing and sharding of documents."""
