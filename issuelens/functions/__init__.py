"""Scalar functions as Spark columns. Two dialects, a and b, differ on purpose and are never mixed."""
