"""Operators for preparing training data at scale: one module per operator.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
and their SQL; ``common`` and ``components`` hold what several operators use.
"""
