"""Column functions: text cleaning, tokens, questions, and the fixed word lists that they use."""
