"""Training-data operators: ten jobs over `documents`, `pages` and `benchmark`.

Nothing outside this subpackage imports it.
"""
