"""Operators for building training corpora. Nothing else in rowlake imports this package."""
