"""Operators for preparing training text: dedup, mixing, decontamination, quality, chat, toxicity, pages, secrets, licenses."""
