"""Named queries: a callable over ``Tables`` and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.sources.tables import Tables, duck_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(t: Tables) -> DataFrame``; ``uses`` names the adapters the oracle text reads."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if uses:
                ctes = duck_ctes(uses)
                low = body[:14].upper()
                if low.startswith("WITH RECURSIVE"):
                    body = f"WITH RECURSIVE {ctes},\n{body[14:]}"
                elif low.startswith("WITH"):
                    body = f"WITH {ctes},\n{body[4:]}"
                else:
                    body = f"WITH {ctes}\n{body}"
            ORACLES[name] = body
        return fn

    return wrap


def load_all() -> None:
    """Import every plan module so that its queries register."""
    import importlib
    import pkgutil

    import newsloom.plans as plans

    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__)):
        if m != "registry":
            importlib.import_module(f"newsloom.plans.{m}")
