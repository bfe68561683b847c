"""Every query of the runtime-integrity operators and the SQL it is checked against."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with the DuckDB SQL of its rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


for _m in ("verification", "scenarios", "normalising", "sequences", "graphs", "rules", "sets", "modelling", "inputs", "holding"):
    importlib.import_module(f"{__package__}.{_m}")
