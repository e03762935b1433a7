"""Operators for preparing training text: dedup, filters, decontamination, tokenising."""
