"""Constraint-driven analytics on Spark: declarative checks, comprehension-style queries and a column function library."""
