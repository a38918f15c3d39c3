"""Writers of corpora and evaluation results."""
