"""Continuous variants of the temporal operators."""
