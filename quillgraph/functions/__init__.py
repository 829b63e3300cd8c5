"""Scalar functions and the rule language."""
