"""Scalar functions as Column expressions; pandas UDFs only where Spark has no such function."""
