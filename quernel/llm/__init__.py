"""Operators for large training corpora. Optional: nothing else in the package imports this part."""
