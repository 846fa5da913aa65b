"""Registered queries: each name maps to a Spark query over the given tables and, where SQL can say it, the same
question in SQL."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (tables) -> DataFrame function under a name, with its SQL twin."""

    def add(fn):
        from upland.queries.tables import Tables

        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = re.sub(r"(?<![\w\"'])by(?![\w\"'])", '"by"', sql)   # a column named by needs its quotes
        return fn

    return add


def load_all():
    from upland.queries import city, places, reports, spatial  # noqa: F401
    return QUERIES, ORACLES
