"""Relational operators: filters, views, profiles, duplicates, comparisons."""
