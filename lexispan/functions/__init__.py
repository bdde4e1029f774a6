"""Scalar functions as Columns, and the fixed values they use."""
