"""How the plans register a query with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order
from ..registry import query
from ..sources.crosswalk import run_sql, with_ctes


def sql(name: str, tables: str, text: str, duck: str | None = None, oracle: bool = True) -> None:
    """Registers a query in SQL over the named tables; `duck` is its DuckDB form where the dialects differ beyond the marks."""
    names = tables.split()

    def run(spark, sf_dir):
        out = run_sql(spark, sf_dir, names, text)
        return out.withColumn("place", out["place"].cast("long")) if "place" in out.columns else out  # row_number() is an int here

    query(name, with_ctes(names, duck or text) if oracle else None)(run)


def placed(name: str, tables: str, text: str, by: str, then: str = "TRUE") -> None:
    """Registers a query in SQL with each row's `place` in a total order, which no task holds as a whole.

    `by` names columns, descending where marked; `then` filters the numbered rows.  Columns that start with _ only order.
    """
    names = tables.split()
    keys = [k.strip().split() for k in by.split(",")]

    def run(spark, sf_dir):
        columns = [F.col(c).desc() if down else F.col(c).asc() for c, *down in keys]
        found = order.placed(run_sql(spark, sf_dir, names, text), columns).where(then)
        return found.select(*(c for c in found.columns if not c.startswith("_")))

    ranked = f"SELECT *, row_number() OVER (ORDER BY {by}) AS place FROM ({text}) AS t"
    hidden = [c for c, *_ in keys if c.startswith("_")]
    exclude = f" EXCLUDE ({', '.join(hidden)})" if hidden else ""
    query(name, with_ctes(names, f"SELECT *{exclude} FROM ({ranked}) AS r WHERE {then}"))(run)
