"""Relational operators on canonical tables; each takes and gives DataFrames or columns."""
