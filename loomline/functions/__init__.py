"""Column functions: identifier spelling, accounts, text cleaning, URLs."""
