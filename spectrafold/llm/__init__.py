"""Operators for cleaning text corpora: one module per operator, general interfaces, no use of the rest of the library
but its session helper. ``queries`` registers one query per operator."""
