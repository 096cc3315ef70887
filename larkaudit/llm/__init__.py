"""Operators for large training-data corpora; nothing else in larkaudit imports this package."""
