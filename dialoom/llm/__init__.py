"""Operators on training documents: language, rules, quality, toxicity, duplicates, tokens and packing."""
