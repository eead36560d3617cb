"""Whole plans: the analysis of a corpus of packages, and the registered queries."""
