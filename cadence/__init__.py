"""Spark-first analytics over timed event sequences and the catalogues that describe them."""
