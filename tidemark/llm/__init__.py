"""Operators for preparing training text: each is a Spark job over whole tables."""
