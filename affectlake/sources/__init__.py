"""Readers of corpora, annotations, lexicons and job specifications."""
