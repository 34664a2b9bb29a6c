"""Operators on corpora of texts. Nothing outside this subpackage imports it."""
