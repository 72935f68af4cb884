"""Where the query modules put their queries and the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafwork.queries.inputs import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, **inputs: str):
    """Registers a function of derived tables, each given as the SQL that makes it; ``sql`` may name them as common tables."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(**{name: derive(spark, sf_dir, text) for name, text in inputs.items()})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            body = sql.strip()
            recursive = body.upper().startswith("WITH RECURSIVE")
            common = ", ".join(f"{name} AS ({text.strip()})" for name, text in inputs.items())
            if body.upper().startswith("WITH"):
                rest = body[len("WITH RECURSIVE") if recursive else len("WITH") :].strip()
                ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{common}, {rest}"
            else:
                ORACLE_SQL[f.__name__] = f"WITH {common} {body}"
        return f

    return register
