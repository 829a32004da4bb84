"""Operators for preparing training data: documents in, cleaned and packed corpora out."""
