"""Rows and segments made by hand, checked as they are appended."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from remitta.errors import CellError, RowError, SegmentWriteError
from remitta.functions.values import quoted
from remitta.operators.lexer import Delimiters
from remitta.plans.spec import Spec
from remitta.sources.remittance import schema, table_columns

_FIT = {"int": (int,), "decimal": (Decimal, int), "date": (datetime.date,), "time": (int,), "binary": (str, bytes)}


def table_of(spark: SparkSession, spec: Spec, name: str, rows: list[tuple]) -> DataFrame:
    """Rows of a table, all its columns in order; None is null."""
    columns = table_columns(spec, name)
    for row in rows:
        if len(row) != len(columns):
            raise RowError(f'table "{name}" has {len(columns)} columns; the row has {len(row)} cells')
        for (column, kind, _, _), value in zip(columns, row):
            if value is not None and (isinstance(value, bool) or not isinstance(value, _FIT[kind])):
                raise RowError(f'table "{name}" column "{column}": {CellError(kind, value)}')
    out = [tuple(v.encode() if kind == "binary" and isinstance(v, str) else Decimal(v) if kind == "decimal" and v is not None else v for (_, kind, _, _), v in zip(columns, row)) for row in rows]
    return spark.createDataFrame(out, schema(spec, name, True))


def segment_bytes(id: bytes, elements: list[bytes | list[bytes]], d: Delimiters) -> bytes:
    """A segment as written; a composite is a list. Without a release byte no value may hold a delimiter."""

    def safe(value: bytes, element: int, component: int | None) -> bytes:
        if d.release:
            return b"".join(d.release + bytes([c]) if bytes([c]) in (d.element, d.component, d.segment, d.release) else bytes([c]) for c in value)
        for byte in (d.element, d.component, d.segment):
            if byte in value:
                raise SegmentWriteError(byte, element, component)
        return value

    parts = [safe(id, 0, None)]
    for i, e in enumerate(elements, 1):
        parts.append(safe(e, i, None) if isinstance(e, bytes) else d.component.join(safe(p, i, k) for k, p in enumerate(e, 1)))
    return d.element.join(parts) + d.segment


def shown(value) -> str:
    return quoted(value) if isinstance(value, bytes) else repr(value)
