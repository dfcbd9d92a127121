"""The figures that a specification declares over its tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitta.errors import SummaryError
from remitta.plans.spec import Spec


def expression(spec: Spec, name: str):
    """(table, kind, aggregate or field list) of a declared summary."""
    if name not in spec.summaries:
        raise SummaryError(f"no summary {name!r} is declared; known are {', '.join(sorted(spec.summaries)) or 'none'}")
    kind, x = next(iter(spec.summaries[name].items()))
    if kind == "count":
        return x["table"], kind, F.count(F.lit(1))
    if kind == "distinct":  # as text, so 0123 and 123 differ
        return x["table"], kind, F.count_distinct(F.col(x["column"]).cast("string"))
    if kind == "sum":
        return x["table"], kind, F.coalesce(F.sum(x["column"]), F.lit(0))
    return x["table"], kind, [(f["name"], f["column"]) for f in x["fields"]]


def summary_frame(spec: Spec, tables: dict[str, DataFrame], name: str, by: list[str] | None = None) -> DataFrame:
    """One row for each group of `by` (such as filename); for a row summary, groups with other than one row show n_rows."""
    table, kind, what = expression(spec, name)
    if table not in tables:
        raise SummaryError(f"summary {name!r} reads table {table!r}, which is missing")
    df = tables[table]
    needed = [c for _, c in what] if kind == "row" else []
    if kind in ("distinct", "sum"):
        needed = [next(iter(spec.summaries[name].values()))["column"]]
    for c in needed:
        if c not in df.columns:
            raise SummaryError(f"summary {name!r} reads column {c!r}, which table {table!r} does not have")
    grouped = df.groupBy(*(by or []))
    if kind == "row":
        return grouped.agg(F.count(F.lit(1)).alias("n_rows"), *[F.first(c).alias(n) for n, c in what])
    return grouped.agg(what.alias(name))


def summary(spec: Spec, tables: dict[str, DataFrame], name: str):
    """The figure itself: a number, or for a row summary its fields (None if all are null)."""
    table, kind, _ = expression(spec, name)
    got = summary_frame(spec, tables, name).first()
    if kind == "row":
        if got is None or got.n_rows != 1:
            raise SummaryError(f"summary {name!r} needs one row in table {table!r}; it has {0 if got is None else got.n_rows}")
        fields = {k: v for k, v in got.asDict().items() if k != "n_rows"}
        return fields if any(v is not None for v in fields.values()) else None
    value = got[name]
    return Decimal(value) if kind == "sum" else value
