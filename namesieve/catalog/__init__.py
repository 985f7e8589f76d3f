"""Registered queries and the SQL they are compared with."""

from namesieve.catalog import evaluating, jobs, lists, matching, reporting

_MODULES = (matching, lists, jobs, reporting, evaluating)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
