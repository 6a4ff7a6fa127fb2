"""Registers queries with the SQL that checks them."""

from __future__ import annotations


def registry(default_prefix: str = ""):
    queries, oracles = {}, {}

    def query(sql: str | None = None, prefix: str = default_prefix):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = prefix + sql
            return f

        return add

    return queries, oracles, query
