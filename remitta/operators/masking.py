"""Patient data: names and ids become keyed tokens, dates are cut to their year, shifted or kept.

In a read the key travels in the closure of the parsing task, never in a plan. columns.py has the same operations as
column expressions.
"""

from __future__ import annotations

import dataclasses
import datetime

from remitta.errors import MaskError
from remitta.functions.values import date_element, parse_dt, shift_days, token
from remitta.operators.checks import Finding
from remitta.plans.spec import Spec, Table

DATE_MODES = ("year", "shift", "keep")


@dataclasses.dataclass(frozen=True)
class Mask:
    key: bytes = dataclasses.field(repr=False)
    dates: str = "year"

    def __post_init__(self):
        if len(self.key) < 16:
            raise MaskError(f"the mask key has {len(self.key)} bytes; at least 16 are needed")
        if self.dates not in DATE_MODES:
            raise MaskError(f"unknown date mode {self.dates!r}; known are {', '.join(DATE_MODES)}")

    def date(self, value: datetime.date, shift: int | None) -> datetime.date:
        if self.dates == "keep":
            return value
        if self.dates == "shift" and shift is not None:
            try:
                return value + datetime.timedelta(days=shift)
            except OverflowError:
                pass
        return value.replace(month=1, day=1)

    def row(self, table: Table, values: list, seed: bytes | None) -> list:
        """values: of all columns; those of the table are the last."""
        shift = shift_days(self.key, seed) if seed and self.dates == "shift" else None
        first = len(values) - len(table.columns)
        out = list(values)
        for i, c in enumerate(table.columns):
            v = out[first + i]
            if c.phi and v:
                out[first + i] = self.date(v, shift) if c.phi == "date" else token(self.key, c.phi, v)
        return out


class Places:
    """Where patient data stands in segments, for findings that quote it."""

    def __init__(self, spec: Spec, mask: Mask):
        self.mask, self.kinds = mask, {}
        for t in spec.tables:
            for c in t.columns:
                if c.phi and not c.index:
                    spots = [c.element] if c.element is not None else range((t.repeat or (0, 1))[0] + c.offset, 60, (t.repeat or (0, 1))[1])
                    for p in spots:
                        self.kinds.setdefault((c.segment, p, c.component), c.phi)

    def hide(self, f: Finding, segment: bytes | None) -> Finding:
        """segment: the id of the finding's segment."""
        if segment is None or f.element is None or not f.datum:
            return f
        kind = self.kinds.get((segment, f.element, f.component)) or (self.kinds.get((segment, f.element, None)) if f.component is None else None)
        if kind is None or kind == "date" and self.mask.dates == "keep":
            return f
        if kind == "date":
            day = parse_dt(f.datum)
            f.datum = date_element(day.replace(month=1, day=1)) if day else token(self.mask.key, "date", f.datum)
        else:
            f.datum = token(self.mask.key, kind, f.datum)
        return f
