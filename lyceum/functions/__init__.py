"""Scalar functions: each takes columns and returns a column, without Python in the executors."""
