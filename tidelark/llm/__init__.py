"""Operators for cleaning and packing training text on Spark.

Nothing outside this folder imports it.  Each module holds one operator with
its own general interface; ``queries`` derives the registered queries.
"""
