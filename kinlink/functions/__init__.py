"""Column functions: text normalisation, phonetic codes, string similarity."""
