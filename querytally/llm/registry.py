"""Registry of this subpackage's queries and, where SQL can state it, their result."""

from __future__ import annotations

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register
