"""Corpus operators. Nothing else in quadrille imports this package."""
