"""Column functions and the fixed word lists that they use."""
