"""Registered queries over the given tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import functions as F

CUT = 0.5013717
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_MODULES = ("core", "crosssection", "measures", "replay", "desk", "reports", "files", "composites")


def register(name: str, sql: str | None = None):
    """Put a ``(spark, sf_dir) -> DataFrame`` function under ``name``, with its SQL check."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def rnd(c, digits: int = 6):
    """Round by plain double arithmetic, which both engines do alike to the last bit.

    The cut lies a little off one half, so a decimal tie with noise in its last bit
    falls on the same side everywhere.
    """
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.floor(c.cast("double") * m + F.lit(CUT)) / F.lit(m)


def r6(expr: str, digits: int = 6) -> str:
    """``rnd`` as SQL text."""
    m = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(floor(CAST({expr} AS DOUBLE) * {m} + CAST({CUT} AS DOUBLE)) / {m})"


def load_all() -> None:
    for m in _MODULES:
        import_module(f"panelspark.queries.{m}")
