"""Column functions: text cleaning, label encoding, array mathematics."""
