"""Tables to 835 files.

Cells become element text in column expressions; the rows of a file then meet in one task, which nests them, lays out
the segments, adds the envelope and reads the result back. What the read finds, and what could not be placed, are the
findings; a file with findings is not written unless that is asked for. Amounts are never filled in.
"""

from __future__ import annotations

import dataclasses
import datetime
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitta.errors import CopyError, PlanError, WriteError
from remitta.functions import columns as C
from remitta.functions.values import ElementTextError, date_element, escape, printable, quoted, time_element
from remitta.operators.checks import place
from remitta.operators.engine import Run
from remitta.operators.lexer import Delimiters
from remitta.plans.builtin import VERSIONS, builtin
from remitta.plans.spec import Column, Spec, Table

_FINDINGS = "array<struct<kind:string,table:string,row:bigint,column:string,message:string>>"


@dataclasses.dataclass(frozen=True)
class Envelope:
    """What the tables can't give."""

    sender: str
    receiver: str
    date: datetime.date | str
    time: int | str  # seconds of the day, or HHMM
    sender_qualifier: str = "ZZ"
    receiver_qualifier: str = "ZZ"
    usage: str = "P"
    control_number: int = 1
    application_sender: str | None = None
    application_receiver: str | None = None
    delimiters: Delimiters = Delimiters(repetition=b"^")
    line_break: bool = False

    def dated(self, longest: int) -> bytes:
        day = self.date if isinstance(self.date, datetime.date) else datetime.datetime.strptime(self.date, "%Y%m%d").date()
        return date_element(day, longest)

    def timed(self) -> bytes:
        return self.time.encode() if isinstance(self.time, str) else time_element(self.time, 4)


# Runs and packing, as DataFrame operations


def islands(df: DataFrame, within: list[str], equal: list[str], order: str) -> DataFrame:
    """Adds `island`: the number of the run of equal values that a row is in, from 0."""
    w = Window.partitionBy(*within).orderBy(order)
    changed = None
    for c in equal:
        new = ~F.col(c).eqNullSafe(F.lag(c).over(w))
        changed = new if changed is None else changed | new
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first, 0).when(changed, 1).otherwise(0)).withColumn("island", F.sum("__new").over(w)).drop("__new")


def packed(df: DataFrame, equal: list[str], capacity: int, order: str = "row") -> DataFrame:
    """Adds `island` and `part`: rows of one segment, at most `capacity` of them. equal starts with the file's name."""
    runs = islands(df, equal[:1], equal[1:], order)
    at = F.row_number().over(Window.partitionBy(equal[0], "island").orderBy(order)) - 1
    return runs.withColumn("part", F.floor(at / capacity))


# The plan: where each column is written


@dataclasses.dataclass
class Line:
    """A segment of a loop instance: its place in the order, fixed elements, and the columns that fill it."""

    segment: bytes
    pos: int
    fixed: dict[int, bytes]
    columns: list[tuple[int, Column]] = dataclasses.field(default_factory=list)
    opens: bool = False


class Plan:
    def __init__(self, spec: Spec):
        self.spec = spec
        self.of_loop: dict[int, Table] = {a: t for t in spec.tables if t.segment is None for a in t.anchors}
        self.repeats: dict[int, list[Table]] = defaultdict(list)
        for t in spec.tables:
            if t.segment is not None:
                for a in t.anchors:
                    self.repeats[a].append(t)
        self.lines: dict[int, list[Line]] = defaultdict(list)
        self.groups: dict[int, tuple[Table, list[int]]] = {}  # loops whose instances are runs of carried columns
        self.inside: dict[int, Table] = {}
        self._given: dict[bytes, list] = {}
        self._repeated: dict[str, tuple[Line, Line]] = {}
        for loop in spec.loops:
            on = self._line(loop.index, loop.trigger, loop.where, opens=True)
            if loop.index in self.of_loop or loop.parent is not None:
                self.lines[loop.index].append(on)
        for t in spec.tables:
            if t.segment is not None:
                self._refuse_repeats(t)
                continue
            for k, c in enumerate(t.columns):
                if c.index:
                    raise PlanError(f"table {t.name!r} column {c.name!r} reads the index of a segment; a specification with such a column can't be written")
                if c.pick != "first":
                    raise PlanError(f"table {t.name!r} column {c.name!r} picks the {c.pick} match; only the first can be written")
                if len(t.anchors) > 1 and c.loop is None and any(c.segment == spec.loops[a].trigger for a in t.anchors[1:]):
                    raise PlanError(f"table {t.name!r} has several anchors; its rows don't tell which loop they open")
                loop = t.anchors[0] if c.loop is None else c.loop
                if loop in spec.chain(t.anchors[0])[:-1]:
                    self.groups.setdefault(loop, (t, []))[1].append(k)
                elif loop != t.anchors[0]:
                    self.inside[loop] = t
                self._place(loop, k, c)

        self._refuse()

    def _refuse_repeats(self, t: Table) -> None:
        for a in t.anchors:
            if t.segment == self.spec.loops[a].trigger:
                raise PlanError(f'table "{t.name}" reads the segment {t.segment.decode()}, which opens loop "{self.spec.loops[a].name}"; its rows would open the loop')
            if not any(o.segment == t.segment for o in self.spec.loops[a].occurrences):
                raise PlanError(f'table "{t.name}" reads the segment {t.segment.decode()}, which matches no occurrence of loop "{self.spec.loops[a].name}"; it can\'t be placed')
        places = {}
        for c in t.columns:
            at = (c.element, c.offset, c.component)
            if at in places:
                raise PlanError(f'table "{t.name}" columns "{places[at]}" and "{c.name}" write the same element')
            places[at] = c.name
            if c.index:
                raise PlanError(f"table {t.name!r} column {c.name!r} reads the index of a segment; a specification with such a column can't be written")

    def _refuse(self) -> None:
        """What every written file would lack or hold twice."""
        spec = self.spec
        given = {t.anchors[i] for t in spec.tables if t.segment is None for i in range(len(t.anchors))}
        written = given | set(self.groups) | set(self.inside)
        for x in spec.loops:
            if x.index not in given:
                continue
            for c in x.children:
                child = spec.loops[c]
                if child.required and c not in written and child.control is None and not any(c in spec.chain(w) for w in written):
                    raise PlanError(f'loop "{x.name}" requires loop "{child.name}" (trigger {child.trigger_text()}), but no table and no column gives it instances')
            lines = self.lines[x.index]
            for o in x.occurrences:
                if not o.required or o.segment in (x.trigger, x.end):
                    continue
                if not any(n.segment == o.segment and (o.element is None or n.fixed.get(o.element) in o.values) for n in lines) and not any(t.segment == o.segment for t in self.repeats[x.index]):
                    raise PlanError(f'occurrence "{o.name}" ({o.selector()}) of loop "{x.name}" is required, but no column writes it')
        for loop, lines in self.lines.items():
            for n in lines:
                places = {}
                for _, c in n.columns:
                    at = (c.element, c.component)
                    if at in places:
                        raise PlanError(f'columns "{places[at]}" and "{c.name}" of loop "{spec.loops[loop].name}" write the same element {n.segment.decode()}{c.element:02}')
                    places[at] = c.name
                same = [o for o in spec.loops[loop].occurrences if o.segment == n.segment]
                if not n.opens and not same:
                    raise PlanError(f'column "{n.columns[0][1].name}" reads the segment {n.segment.decode()}, which matches no occurrence of loop "{spec.loops[loop].name}"; it can\'t be placed')
                fit = [o for o in same if o.element is None or n.fixed.get(o.element) in o.values]
                if not n.opens and len(same) > 1 and len(fit) != 1 and n.columns:
                    raise PlanError(f'column "{n.columns[0][1].name}" reads the segment {n.segment.decode()}, which matches {len(fit) or len(same)} occurrences of loop "{spec.loops[loop].name}" ({", ".join(o.name for o in fit or same)}); it can\'t be placed')

    def _pos(self, loop: int, segment: bytes, fixed: dict[int, bytes]) -> int:
        same = [o for o in self.spec.loops[loop].occurrences if o.segment == segment]
        fit = [o for o in same if o.element is None or fixed.get(o.element) in o.values]
        return (fit or same)[0].pos if same else 0

    def _line(self, loop: int, segment: bytes, where, opens: bool = False) -> Line:
        fixed = dict(where)
        return Line(segment, self._pos(loop, segment, fixed), fixed, [], opens)

    def _place(self, loop: int, k: int, c: Column) -> None:
        x = self.spec.loops[loop]
        if c.occurrence is not None:
            o = x.occurrences[c.occurrence]
            fixed = {o.element: o.values[0]} if o.element is not None else {}
        else:
            fixed = dict(c.where)
        if c.segment == x.trigger and all(dict(x.where).get(p, v) == v for p, v in fixed.items()):
            line = next(n for n in self.lines[loop] if n.opens)
        else:
            line = next((n for n in self.lines[loop] if n.segment == c.segment and n.fixed == fixed and not n.opens), None)
        if line is None:
            line = Line(c.segment, self._pos(loop, c.segment, fixed), fixed)
            self.lines[loop].append(line)
        line.columns.append((k, c))

    def given(self, segment: bytes) -> list[tuple[int, bytes]]:
        """Required codes of a segment: one that no column gives is the first of its list."""
        if segment not in self._given:
            self._given[segment] = [(p, e.codes[0].encode()) for p, e in self.spec.segments.get(segment.decode(), {}).items() if e.required and e.codes]
        return self._given[segment]

    def repeated(self, t: Table) -> tuple[Line, Line]:
        """What the first row of a segment made of several fills, and what each further one does."""
        if t.name not in self._repeated:
            self._repeated[t.name] = tuple(Line(t.segment, 0, {}, [(k, c) for k, c in enumerate(t.columns) if c.offset is not None or first]) for first in (True, False))
        return self._repeated[t.name]

    def capacity(self, t: Table) -> int:
        last = max(self.spec.segments.get(t.segment.decode(), {1: None}))
        return max(1, (last - t.repeat[0] + 1) // t.repeat[1]) if t.repeat else 1


def plan_of(spec: Spec) -> Plan:
    return Plan(spec)


# One file


@dataclasses.dataclass(slots=True)
class Record:
    table: str
    row: int | None
    segment: int | None
    parents: list
    cells: list
    at: int = 0  # position among the table's rows


class Assembler:
    def __init__(self, spec: Spec, plan: Plan, envelope: Envelope, rows: dict[str, list[Record]]):
        self.spec, self.plan, self.envelope, self.rows = spec, plan, envelope, rows
        self.d = envelope.delimiters
        self.out: list[bytes] = []
        self.findings: list[dict] = []
        self.origin: dict[int, dict[tuple, tuple]] = {}  # by segment and place, the row and column of a value
        self.broken = False

    def report(self, kind: str, r: Record | None, column: str | None, message: str) -> None:
        self.findings.append({"kind": kind, "table": r.table if r else None, "row": r.at if r else None, "column": column, "message": message})

    # Rows find their parents

    def nest(self) -> None:
        self.under: dict[tuple, list[Record]] = defaultdict(list)
        self.by_row: dict[str, dict] = {}
        for t in self.spec.tables:
            rows = sorted(self.rows.get(t.name, []), key=lambda r: (r.row is None, r.row))
            self.rows[t.name] = rows
            seen: dict = {}
            for i, r in enumerate(rows):
                r.at = i
                if r.row is None:
                    r.row = i
                if r.row in seen and t.segment is None:
                    self.report("DuplicateRowNumber", r, "row", f'table "{t.name}" row {i} carries row number {r.row}, which row {seen[r.row].at} already carries; references to it are ambiguous')
                seen.setdefault(r.row, r)
            self.by_row[t.name] = seen
        for t in self.spec.tables:
            last: tuple = ()
            for r in self.rows[t.name]:
                key = self._parents(t, r)
                if key is None:
                    continue
                if key < last:
                    self.report("OutOfOrder", r, self.spec.table(t.parents[-1]).ref if t.parents else "row", f'table "{t.name}" row {r.at} is written after row {r.at - 1}; the rows of one parent must be together and in their parents\' order')
                last = max(last, key)
                deepest = next((n for n, p in zip(reversed(t.parents), reversed(r.parents)) if p is not None), None)
                owner = None if deepest is None else (deepest, r.parents[t.parents.index(deepest)])
                self.under[t.name, owner].append(r)

    def _parents(self, t: Table, r: Record) -> tuple | None:
        """Positions of the rows above, outermost first; None if one is missing."""
        key = []
        for i, name in enumerate(t.parents):
            ref, value = self.spec.table(name).ref, r.parents[i]
            optional = t.segment is not None and i == len(t.parents) - 1 and len(t.anchors) > 1
            if value is None and optional:
                key.append(-1)
                continue
            above = self.by_row[name].get(value)
            if above is None:
                said = "is null" if value is None else f"is {value}, which no row of table {name!r} carries".replace("'", '"')
                self.report("MissingParent", r, ref, f'table "{t.name}" row {r.at} column "{ref}" {said}, so the row has no place in the file')
                return None
            for k, upper in enumerate(self.spec.table(name).parents):
                want, have = above.parents[k], r.parents[t.parents.index(upper)]
                if have is not None and want is not None and have != want:
                    uref = self.spec.table(upper).ref
                    self.report("MismatchedReference", r, uref, f'table "{t.name}" row {r.at} column "{uref}" is {have}, but the row it belongs to by column "{ref}", row {above.at} of table "{name}", has "{uref}" {want}')
                    return None
            key.append(above.at)
        return tuple(key)

    # Segments

    def emit(self, segment: bytes, elements: dict, origins: dict) -> None:
        """elements: position -> bytes, or component -> bytes in a dictionary; None is no element."""
        index, d = len(self.out), self.d
        for p, code in self.plan.given(segment):
            if p not in elements:
                elements[p] = code
        self.origin[index] = origins
        last = max([p for p, v in elements.items() if v is not None and (not isinstance(v, dict) or any(x is not None for x in v.values()))], default=0)
        parts, inner = [segment], 0
        for p in range(1, last + 1):
            v = elements.get(p)
            if isinstance(v, dict):
                end = max([c for c, x in v.items() if x is not None], default=0)
                inner += max(0, end - 1)
                v = d.component.join([v.get(c) or b"" for c in range(1, end + 1)])
            parts.append(v or b"")
        whole = d.element.join(parts)
        # no more delimiters than were put between the values: none is in a value
        if d.release or whole.count(d.element) != last or whole.count(d.component) != inner or d.segment in whole or d.repetition and d.repetition in whole:
            whole = d.element.join([segment, *(self._guarded(segment, p, elements.get(p), origins) for p in range(1, last + 1))])
        self.out.append(whole)

    def _guarded(self, segment: bytes, p: int, v, origins: dict) -> bytes:
        if not isinstance(v, dict):
            return self._safe(v or b"", segment, p, None, origins.get((p, None)))
        end = max((c for c, x in v.items() if x is not None), default=0)
        return self.d.component.join(self._safe(v.get(c) or b"", segment, p, c, origins.get((p, c))) for c in range(1, end + 1))

    def _safe(self, value: bytes, segment: bytes, position: int, component: int | None, origin) -> bytes:
        d = self.d
        roles = [(d.element, "element separator"), (d.component, "component separator"), (d.segment, "segment terminator")]
        if d.release and origin is not None:
            value_out = escape(value, d.release, d.element + d.component + d.segment)
            roles = []
        else:
            value_out = value
        for byte, role in [*roles, *([(d.repetition, "repetition separator")] if d.repetition else [])]:
            if byte in value and origin is not None:
                self.broken |= role != "repetition separator"
                r, column = origin
                self.report("DelimiterInValue", r, column, f'table "{r.table}" row {r.at} column "{column}" writes {place(segment, position, component)} with {quoted(value)}, which holds the {role} {quoted(byte)}; a value cannot hold the interchange\'s delimiters')
        return value_out

    def _fill(self, line: Line, cells: list, r: Record, t: Table, start: int = 0) -> tuple[dict, dict, bool]:
        elements: dict = dict(line.fixed)
        origins, some = {}, False
        for k, c in line.columns:
            v = cells[k]
            p = c.element if c.element is not None else start + c.offset
            if v is not None:
                some = True
            if v is not None and v.startswith(REFUSED.encode()):
                shown, what = printable(v[1:]), "the year has no form of two digits" if c.kind == "date" else "it lies outside a day, or has seconds and the element holds none"
                self.report("NotWritable", r, c.name, f'table "{t.name}" row {r.at} column "{c.name}" holds {shown}, which {place(line.segment, p, c.component)} cannot hold: {what}')
                v = None
            if c.component is not None:
                slot = elements.setdefault(p, {})
                if isinstance(slot, dict):
                    slot[c.component] = v
            elif p in line.fixed:
                if v not in (None, line.fixed[p]):
                    self.report("UnwrittenValue", r, c.name, f'table "{t.name}" row {r.at} column "{c.name}" holds {quoted(v)}, but the element is fixed to {quoted(line.fixed[p])}')
            else:
                elements[p] = v
            origins[p, c.component] = (r, c.name)
        return elements, origins, some

    def _excluded(self, line: Line) -> tuple | None:
        """A fixed code that the element's own list doesn't hold, so no valid file has the segment."""
        known = self.spec.segments.get(line.segment.decode(), {})
        for p, v in line.fixed.items():
            if p in known and known[p].codes and v.decode() not in known[p].codes:
                return p, v, known[p].codes
        return None

    def instance(self, loop: int, r: Record, t: Table) -> None:
        """A loop instance whose own segments are filled from a row."""
        x, items = self.spec.loops[loop], []
        own = t if loop in t.anchors else None
        for line in self.plan.lines[loop]:
            elements, origins, some = self._fill(line, r.cells, r, t)
            if not (some or line.opens):
                continue
            bad = self._excluded(line)
            if bad and not line.opens:
                for k, c in line.columns:
                    if r.cells[k] is not None:
                        self.report("UnwrittenValue", r, c.name, f'table "{t.name}" row {r.at} column "{c.name}" holds {quoted(r.cells[k])}, but the column reads {place(line.segment, bad[0])} {quoted(bad[1])}, which the element\'s code list ({", ".join(quoted(z.encode()) for z in bad[2])}) excludes, so no valid file holds it')
                continue
            if line.opens and x.control:
                elements = self._control(x, elements)
            items.append((-1 if line.opens else line.pos, len(items), (self.emit, (line.segment, elements, origins or {(1, None): (r, t.columns[0].name if t.columns else "row")}))))
        if own is not None:
            owner = (t.name, r.row)
            for rt in self.plan.repeats.get(loop, ()):
                for group in self._pack(rt, [q for q in self.under.get((rt.name, owner), ())]):
                    items.append((self.plan._pos(loop, rt.segment, {}), len(items), (self._repeat, (rt, group))))
        for child in x.children:
            y = self.spec.loops[child]
            pos = y.occurrences[0].pos if y.occurrences else 0
            if child in self.plan.inside and self.plan.inside[child] is t:
                line_cells = [k for line in self.plan.lines[child] for k, _ in line.columns]
                if y.required or any(r.cells[k] is not None for k in line_cells):
                    items.append((pos, len(items), (self.instance, (child, r, t))))
            elif child in self.plan.of_loop and own is not None:
                ct = self.plan.of_loop[child]
                for q in self.under.get((ct.name, (t.name, r.row)), ()):
                    items.append((pos, len(items), (self.instance, (child, q, ct))))
            elif child in self.plan.groups and own is not None:
                gt, columns = self.plan.groups[child]
                run: list[Record] = []
                for q in [*self.under.get((gt.name, (t.name, r.row)), ()), None]:
                    if run and (q is None or any(q.cells[k] != run[0].cells[k] for k in columns)):
                        items.append((pos, len(items), (self._group, (child, run, gt))))
                        run = []
                    if q is not None:
                        run.append(q)
        begin = len(self.out)
        for _, _, (f, args) in sorted(items, key=lambda i: i[:2]):
            f(*args)
        if x.control and x.end:
            self._end(x, begin)

    def _group(self, loop: int, run: list[Record], t: Table) -> None:
        for line in sorted(self.plan.lines[loop], key=lambda n: (not n.opens, n.pos)):
            elements, origins, some = self._fill(line, run[0].cells, run[0], t)
            if some or line.opens:
                self.emit(line.segment, elements, origins)
        anchor = t.anchors[0]
        for r in run:
            self.instance(anchor, r, t)

    def _pack(self, t: Table, rows: list[Record]) -> list[list[Record]]:
        outside = [k for k, c in enumerate(t.columns) if c.offset is None]
        most, groups = self.plan.capacity(t), []
        for r in rows:
            same = groups and len(groups[-1]) < most and groups[-1][0].segment == r.segment and r.segment is not None and all(groups[-1][0].cells[k] == r.cells[k] for k in outside)
            if same:
                groups[-1].append(r)
            else:
                groups.append([r])
        return groups

    def _repeat(self, t: Table, group: list[Record]) -> None:
        elements, origins, lines = {}, {}, self.plan.repeated(t)
        for i, r in enumerate(group):
            start = t.repeat[0] + i * t.repeat[1] if t.repeat else 0
            e, o, _ = self._fill(lines[i > 0], r.cells, r, t, start)
            elements |= e
            origins |= o
        self.emit(t.segment, elements, origins)

    # The envelope

    def _control(self, x, elements: dict) -> dict:
        self.transactions += 1
        known = self.spec.segments.get(x.trigger.decode(), {})
        least = known[x.control["opener_element"]].min if x.control["opener_element"] in known else 1
        self.number = str(self.transactions).zfill(least).encode()
        first = known[1].codes[0].encode() if 1 in known and known[1].codes else b""
        return {1: first, **elements, x.control["opener_element"]: self.number}

    def _end(self, x, begin: int) -> None:
        self.emit(x.end, {x.control["count_element"]: str(len(self.out) - begin + 1).encode(), x.control["closer_element"]: self.number}, {})

    def file(self) -> bytes:
        e, d = self.envelope, self.d
        self.nest()
        self.transactions = 0
        isa, gs = self.spec.segments.get("ISA", {}), self.spec.segments.get("GS", {})
        code = lambda known, p, other: known[p].codes[0].encode() if p in known and known[p].codes else other
        version = code(isa, 12, b"00501")
        if d.repetition is None and not (11 in isa and isa[11].codes):
            raise WriteError(f"the interchange version {printable(version)} (ISA12) carries a repetition separator in ISA11, but the envelope's delimiters have none")
        number = str(e.control_number).zfill(9).encode()
        wide = lambda v: v.encode().ljust(15)
        repetition = code(isa, 11, b"") or d.repetition
        head = [b"00", b" " * 10, b"00", b" " * 10, e.sender_qualifier.encode(), wide(e.sender), e.receiver_qualifier.encode(), wide(e.receiver), e.dated(6), e.timed(), repetition, version, number, b"0", e.usage.encode(), d.component]
        for v in head[:10]:
            for byte in (d.element, d.component, d.segment):
                if byte in v:
                    self.broken = True
                    self.findings.append({"kind": "DelimiterInValue", "table": None, "row": None, "column": None, "message": f"the envelope writes {quoted(v)}, which holds a delimiter"})
        self.out.append(d.element.join([b"ISA", *head]))
        first = str(e.control_number).encode()
        sender, receiver = (e.application_sender or e.sender).rstrip(), (e.application_receiver or e.receiver).rstrip()
        self.out.append(d.element.join([b"GS", code(gs, 1, b"HP"), sender.encode(), receiver.encode(), e.dated(8), e.timed(), first, code(gs, 7, b"X"), code(gs, 8, b"")]))
        top = next((x for x in self.spec.loops if x.control and x.control["count"] == "segments"), None)
        if top is None or top.index not in self.plan.of_loop:
            raise PlanError("no table is anchored on the loop whose end counts segments; the specification can't be written")
        self.transactions_of(top, self.plan.of_loop[top.index])
        self.out.append(d.element.join([b"GE", str(self.transactions).encode(), first]))
        self.out.append(d.element.join([b"IEA", b"1", number]))
        return b"".join(s + d.segment + b"\n" * e.line_break for s in self.out)

    def transactions_of(self, x, t: Table) -> None:
        for r in self.rows[t.name]:
            self.instance(x.index, r, t)

    def checked(self) -> bytes:
        """The file, after it was read back; what the read finds is reported at the cell it comes from."""
        data = self.file()
        if self.broken:
            return data
        for f in Run(data, self.spec, self.d, findings=True).all().found:
            of = self.origin.get(f.segment, {})
            o = of.get((f.element, f.component)) or of.get((f.element, None)) or next(iter(of.values()), None)
            r, column = o if o else (None, None)
            where = f'table "{r.table}" row {r.at} column "{column}"' if r else "the envelope"
            self.report("ReadBack", r, column if r else None, f"{where}: {f.message()}")
        return data


# DataFrames


#: Begins a cell whose value has no form in its element.
REFUSED = "\0"


def _longest(spec: Spec, t: Table, c: Column) -> int:
    known = spec.segments.get((c.segment or b"").decode(), {})
    e = known.get(c.element if c.element is not None else (t.repeat or (0, 0))[0] + (c.offset or 0))
    e = dict(e.parts).get(c.component) if e is not None and c.component else e
    return 8 if e is None or e.max is None else e.max


def _cell(spec: Spec, t: Table, c: Column, kind: str):
    """A column as element text."""
    x = F.col(f"`{c.name}`")
    if c.kind == "decimal":
        return C.decimal_element(C.rescale(x, c.scale)).cast("binary") if kind.startswith("decimal") else C.decimal_element(C.rescale(x.cast("decimal(38,18)"), c.scale)).cast("binary")
    longest = _longest(spec, t, c)
    refused = lambda value: F.concat(F.lit(REFUSED), value.cast("string"))
    if c.kind == "date":
        day = x if kind == "date" else C.whole_days(x)
        return F.when(day.isNotNull(), F.coalesce(C.date_element(day, longest), refused(day))).cast("binary")
    if c.kind == "time":
        held = (x >= 0) & (x < 86_400) & (F.lit(longest >= 6) | (x % 60 == 0))
        return F.when(held, C.time_element(x)).when(x.isNotNull(), refused(x)).cast("binary")
    return x.cast("string").cast("binary") if kind != "binary" else x


def check_types(spec: Spec, t: Table, df: DataFrame) -> None:
    """Unknown columns, and types that can't hold the values; floats are refused for amounts."""
    known = {n: k for n, k, _, _ in spec.columns_of(t)}
    for name, kind in df.dtypes:
        if name == "filename":
            continue
        if name not in known:
            raise WriteError(f'table "{t.name}" has no column "{name}"; the spec declares {", ".join(known)}')
        fit = {"int": ("tinyint", "smallint", "int", "bigint", "decimal", "void"), "decimal": ("decimal", "tinyint", "smallint", "int", "bigint", "void"), "date": ("date", "timestamp", "void"), "time": ("int", "bigint", "void"), "binary": ("string", "binary", "void")}[known[name]]
        if known[name] == "decimal" and kind in ("float", "double"):
            raise CopyError(f'table "{t.name}" column "{name}" is {kind}; amounts take exact decimals')
        if not kind.startswith(fit):
            raise WriteError(f'table "{t.name}" column "{name}" is {kind}; the spec makes it {known[name]}')


def _plain(column: pa.ChunkedArray) -> list:
    """As to_pylist; values that numpy makes objects of are made at once."""
    out = []
    for x in column.chunks:
        if pa.types.is_list(x.type):
            flat, ends = _plain(pa.chunked_array([x.flatten()])), np.cumsum(pc.fill_null(pc.list_value_length(x), 0)).tolist()
            out += [flat[i:j] for i, j in zip([0, *ends], ends)]
        elif pa.types.is_integer(x.type) and x.null_count:
            out += x.to_pylist()
        else:
            out += x.to_numpy(zero_copy_only=False).tolist()
    return out


def write_files(tables: dict[str, DataFrame], envelope: Envelope, spec: Spec | None = None, strict: bool = True) -> DataFrame:
    """filename, content, findings: a file for each filename in the tables (one file without such a column).

    strict: a file with findings has no content. The rows of a file meet in one task, as a file is a unit of at most 2 GiB.
    """
    spec = spec or builtin()
    plan, every = Plan(spec), None
    envelope.delimiters.checked()
    for name in tables:
        if name not in spec.table_names:
            raise WriteError(f'unknown table "{name}"; the spec declares {", ".join(spec.table_names)}')
    for name, df in tables.items():
        t = spec.table(name)
        check_types(spec, t, df)
        kinds = dict(df.dtypes)
        have = lambda c: F.col(f"`{c}`").cast("bigint") if c in kinds else F.lit(None).cast("bigint")  # noqa: E731, B023
        cells = [_cell(spec, t, c, kinds[c.name]) if c.name in kinds else F.lit(None).cast("binary") for c in t.columns]
        part = df.select(
            F.col("filename") if "filename" in kinds else F.lit("out.835").alias("filename"), F.lit(name).alias("table"), have("row").alias("row"), have("segment").alias("segment"),
            F.array(*[have(spec.table(p).ref) for p in t.parents]).cast("array<bigint>").alias("parents"), F.array(*cells).cast("array<binary>").alias("cells"),
        )
        every = part if every is None else every.unionByName(part)

    def one(key, rows):
        from remitta.operators.layout import laid_out

        data = laid_out(spec, plan, envelope, rows)
        if data is not None:
            return whole(key, data, [])
        by: dict[str, list[Record]] = defaultdict(list)
        for table, row, segment, parents, cells in zip(*(_plain(rows.column(c)) for c in ("table", "row", "segment", "parents", "cells"))):
            by[table].append(Record(table, row, segment, parents, cells))
        a = Assembler(spec, plan, envelope, by)
        data = a.checked()
        return whole(key, None if strict and a.findings else data, a.findings)

    def whole(key, data: bytes | None, findings: list) -> pa.Table:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("table", pa.string()), ("row", pa.int64()), ("column", pa.string()), ("message", pa.string())]))
        return pa.table({"filename": pa.array([key[0].as_py()], pa.string()), "content": pa.array([data], pa.binary()), "findings": pa.array([findings], kind)})

    return every.groupBy("filename").applyInArrow(one, f"filename string, content binary, findings {_FINDINGS}")


def _message(findings: list) -> str:
    n = len(findings)
    return f"the tables do not make a valid file ({n} finding{'s' * (n != 1)}); nothing was written" + "".join(f"\n{i}. {f['message']}" for i, f in enumerate(findings, 1))


def write(tables: dict[str, DataFrame], envelope: Envelope, spec: Spec | None = None, allow_findings: bool = False):
    """The bytes of one file; with allow_findings, the bytes and the findings."""
    rows = write_files({k: v.drop("filename") for k, v in tables.items()}, envelope, spec, strict=False).collect() if tables else []
    if not rows:
        a = Assembler(spec or builtin(), Plan(spec or builtin()), envelope, {})
        data, findings = a.checked(), a.findings
    else:
        data, findings = bytes(rows[0].content), [f.asDict() for f in rows[0].findings]
    if allow_findings:
        return data, findings
    if findings:
        raise WriteError(_message(findings), findings)
    return data


#: Options of copy_835, with their kinds.
OPTIONS = {
    "sender_id": str, "receiver_id": str, "date": (str, datetime.date), "time": (str, int, datetime.time), "sender_qualifier": str, "receiver_qualifier": str, "usage_indicator": str, "control_number": int,
    "application_sender": str, "application_receiver": str, "delimiters": dict, "line_break": bool, "version": str,
}


def copy_835(spark: SparkSession, rows: DataFrame, path: str, **options) -> int:
    """Writes a query of one STRUCT column, a list of structs for each table; lists of several rows follow one another.

    The target appears only after the file was accepted. Returns the number of bytes.
    """
    for k, v in options.items():
        if k in ("compression", "partition_by", "per_thread_output", "file_size_bytes"):
            raise CopyError(f"the option {k} does not apply: one interchange is written")
        if k not in OPTIONS:
            raise CopyError(f"unknown option {k}; known are {', '.join(OPTIONS)}")
        if v is None:
            raise CopyError(f"the option {k} has no value")
        if not isinstance(v, OPTIONS[k]) or isinstance(v, bool) != (OPTIONS[k] is bool):
            raise CopyError(f"the option {k} can't be {v!r}")
    for k in ("sender_id", "receiver_id", "date", "time"):
        if k not in options:
            raise CopyError(f"the option {k} is missing")
    version = options.get("version", VERSIONS[0])
    if version not in VERSIONS:
        raise CopyError(f"unknown version {version!r}; the built-in ones are {', '.join(VERSIONS)}")
    time = options["time"]
    if isinstance(time, datetime.time):
        if time.microsecond:
            raise CopyError("the option time has a fraction of a second")
        time = time.hour * 3600 + time.minute * 60 + time.second
    if isinstance(time, int) and not 0 <= time < 86_400:
        raise CopyError(f"the option time lies outside a day: {time}")
    d = options.get("delimiters")
    if d is not None:
        roles = ("element", "component", "segment", "repetition", "release")
        for k, v in d.items():
            if k not in roles:
                raise CopyError(f"unknown delimiter {k}; known are {', '.join(roles)}")
            if not isinstance(v, str) or len(v.encode()) != 1:
                raise CopyError(f"the delimiter {k} must be one byte; found {v!r}")
        d = Delimiters(**{k: v.encode() for k, v in d.items()})
    if len(rows.columns) != 1:
        raise CopyError(f"the query must return one column; it returns {len(rows.columns)}")
    field = rows.schema.fields[0]
    if field.dataType.typeName() != "struct":
        raise CopyError(f"the column must be a STRUCT; it is {field.dataType.simpleString()}")
    tables = {}
    for x in field.dataType.fields:
        if x.dataType.typeName() != "array" or x.dataType.elementType.typeName() != "struct":
            raise CopyError(f"the field {x.name} must be a list of structs; it is {x.dataType.simpleString()}")
        tables[x.name] = rows.select(F.explode(F.col(f"`{field.name}`.`{x.name}`")).alias("r")).select("r.*")
    try:
        envelope = Envelope(
            options["sender_id"], options["receiver_id"], options["date"], time, options.get("sender_qualifier", "ZZ"), options.get("receiver_qualifier", "ZZ"), options.get("usage_indicator", "P"),
            options.get("control_number", 1), options.get("application_sender"), options.get("application_receiver"), d or Delimiters(repetition=b"^"), options.get("line_break", False),
        )
        data = write(tables, envelope, builtin(version))
    except ElementTextError as e:
        raise CopyError(str(e)) from e
    save(spark, data, path)
    return len(data)


def save(spark: SparkSession, data: bytes, path: str) -> None:
    """Beside the target first, then in its place at once; a longer file that is there already is not replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and fs.getFileStatus(target).getLen() > len(data):
        raise CopyError(f"the file at {path!r} is longer than the {len(data)} bytes to be written; remove it first")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    files.rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def save_each(written: DataFrame, folder: str) -> DataFrame:
    """filename, n_bytes: each task puts its files (filename, content) into a folder that pyarrow's file systems reach, beside the target first."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            names, sizes = [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                if data is None:  # held back for its findings
                    continue
                with store.open_output_stream(f"{base}/{name}.part") as out:
                    out.write(data)
                store.move(f"{base}/{name}.part", f"{base}/{name}")
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["filename", "n_bytes"])

    return written.select("filename", "content").mapInArrow(run, "filename string, n_bytes bigint")
