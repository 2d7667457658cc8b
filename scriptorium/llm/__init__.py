"""Operators that prepare text corpora for model training.

Nothing outside this subpackage imports it: it can be removed without touching
the letter engine.
"""
