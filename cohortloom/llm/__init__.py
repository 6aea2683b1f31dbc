"""Operators that prepare text corpora; nothing else in the library imports them."""
