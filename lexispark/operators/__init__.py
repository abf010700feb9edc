"""Operators over corpora, encodings and vocabularies."""
