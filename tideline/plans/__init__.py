"""Whole plans: from a raw log to sink records, and the catalogue of queries."""
