"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Column names given by the caller are the only ones the operators read; other
columns pass through or are dropped as each docstring says.
"""
