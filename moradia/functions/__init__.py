"""Scalar functions as Spark columns, and the string helpers that Arrow UDFs share."""
