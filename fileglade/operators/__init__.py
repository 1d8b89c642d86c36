"""Relational operators: catalog DataFrame in, DataFrame out."""
