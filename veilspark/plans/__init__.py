"""Whole jobs: dictionary, gate, assessment, and the registered queries."""
