"""Operators for building training corpora; nothing outside this folder uses them."""
