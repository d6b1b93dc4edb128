"""Operators for large-scale text corpora (problems 1-10 of TESTDATA.md).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is importable.
"""
