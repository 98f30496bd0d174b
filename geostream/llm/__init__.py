"""Operators that prepare text and vector corpora for training; nothing outside this subpackage imports it."""
