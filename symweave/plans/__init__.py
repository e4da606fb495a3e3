"""Registered queries and their DuckDB counterparts."""

from symweave.plans import lookups as _lookups  # noqa: F401  (adds its queries to the catalogue)
