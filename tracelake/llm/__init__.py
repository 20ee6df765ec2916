"""Operators for large training corpora. Nothing else in tracelake imports this subpackage."""
