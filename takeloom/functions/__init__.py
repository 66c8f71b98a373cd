"""Column expressions: text normalisation, number words, edit distance."""
