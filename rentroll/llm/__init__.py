"""Operators over text corpora; nothing outside this folder imports them."""
