"""Corpus operators: each is a function on DataFrames; the registry module binds them to the test tables."""
