"""Scalar functions: text, analysis, density and gamma functions."""
