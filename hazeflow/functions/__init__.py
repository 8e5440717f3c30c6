"""Scalar column expressions and row-wise projections."""
