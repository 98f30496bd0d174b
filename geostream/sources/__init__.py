"""Readers of file corpora: each yields a table, parsers also a table of rejects."""
