"""Continuous forms of the board operators."""
