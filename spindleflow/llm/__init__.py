"""Operators for preparing training text: encoding, fingerprints, mixing, extraction, filters, scoring and search.

Every operator is a ``DataFrame -> DataFrame`` function with its own general interface; ``queries`` registers one query
for each of them on the shared tables. Nothing outside this package imports it.
"""
