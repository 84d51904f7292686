"""Name -> query and name -> oracle SQL registries.

Query modules register their functions with :func:`query`; oracle modules
register DuckDB SQL builders with :func:`oracle`. A query takes a
``Tables`` and returns a DataFrame; an oracle builder takes a ``Config`` and
returns SQL over the driver tables (the CTEs are added by the registry).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, Callable] = {}


def query(name: str):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        fn.query_name = name
        return fn
    return deco


def oracle(name: str):
    def deco(fn):
        if name in ORACLES:
            raise ValueError(f"duplicate oracle {name}")
        ORACLES[name] = fn
        return fn
    return deco
