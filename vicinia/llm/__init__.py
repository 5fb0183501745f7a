"""Operations for large training-text corpora; nothing else in the library imports this package."""
