"""A file by columns: what Run does segment by segment, worked out once for each kind of segment in each state.

What a segment does depends on its id and on the few elements that triggers, occurrences and columns look at, and on
the state: the open loops and what they hold so far. Such a step is made by the automaton and the checker themselves,
once, and looked up afterwards. Rows, values and balances are then taken for all segments of a step at once.

It proves that a file has no findings; it doesn't describe any. A file that it can't take (`scanned` gives None) and the
findings of one that isn't `clean` are left to Run.
"""

from __future__ import annotations

import copy
import dataclasses
import functools
import re

import numpy as np
import pyarrow as pa

from remitta.functions.values import parse_dt, parse_n, parse_r, parse_tm, parse_unsigned
from remitta.operators.automaton import Automaton
from remitta.operators.checks import Checker, _Open
from remitta.operators.lexer import BOM, TRIVIA, Delimiters, Segment
from remitta.plans.spec import Column, Spec, Table

#: Kinds of segments and steps that are remembered.
_REMEMBERED = 50_000
_FINE = 200_000
#: Bytes of the largest file that is held by columns, some 20 times as large (an estimate); Run streams.
LARGE = 1 << 25


@functools.lru_cache(32)
def _numbers(scale: int) -> re.Pattern:
    part = rb"(?:\.[0-9]{1,%d}+)?" % scale if scale else b""
    return re.compile(rb"(?:(?:-?[0-9]{1,15}+" + part + rb")?\n)*+")


def decimals(texts: list, scale: int) -> pa.Array:
    """parse_r of each text; empty and None are null."""
    joined = b"\n".join([t or b"" for t in texts]) + b"\n"
    if scale <= 15 and joined.count(b"\n") == max(1, len(texts)) and _numbers(scale).fullmatch(joined):
        return pa.array([t or None for t in texts], pa.string()).cast(pa.decimal128(38, scale))
    return pa.array([parse_r(t, scale) if t else None for t in texts], pa.decimal128(38, scale))


class _Structure(Checker):
    """The checks that depend on the order of segments alone. Limits, control numbers, elements and balances are checked by columns."""

    def __init__(self, spec: Spec, frames: tuple, roots: frozenset):
        super().__init__(spec)
        self.feeds, self.per, self.roots = {}, {}, dict.fromkeys(roots, 1)
        for loop, implicit, counts, children, last, inner, ended in frames:
            o = _Open(loop, implicit, 0, 0, "")
            o.counts, o.child_counts, o.last, o.inner, o.ended = dict.fromkeys(counts, 1), dict.fromkeys(children, 1), last, inner, ended
            self.open.append(o)

    def _ended(self, x, top: _Open, s: Segment) -> None:
        top.ended = True

    def frames(self) -> tuple:
        return tuple((o.loop, o.implicit, frozenset(o.counts), frozenset(o.child_counts), o.last, o.inner, o.ended) for o in self.open)


@dataclasses.dataclass(slots=True, eq=False)
class Step:
    """What a kind of segment does in a state: loops closed, opened (loop, implicit), the holder, loops open then, whether it closes the holder."""

    id: int
    segment: bytes
    closes: tuple
    opens: tuple
    holder: int | None
    occurrence: int | None
    live: frozenset
    ends: bool
    clean: bool
    feeds: frozenset  # groups of columns, and tables of lines
    then: dict  # the steps from there


class Scanner:
    """The steps of a specification, and what its tables and checks read of them."""

    def __init__(self, spec: Spec):
        self.spec, self.machine = spec, Automaton(spec)
        relaxed = copy.copy(spec)
        relaxed.loops = [dataclasses.replace(x, max=None, occurrences=tuple(dataclasses.replace(o, max=None) for o in x.occurrences)) for x in spec.loops]
        self.relaxed = relaxed
        looked: dict[bytes, set] = {}
        for x in spec.loops:
            looked.setdefault(x.trigger, set()).update(p for p, _ in x.where)
            for o in x.occurrences:
                if o.element is not None:
                    looked.setdefault(o.segment, set()).add(o.element)
        self.groups: dict[tuple, list] = {}  # (table, loop, segment, where, occurrence, above) -> columns
        self.refused: set[str] = set()  # tables that Run has to read
        for t in spec.tables:
            if any(a != b and a in spec.chain(b) for x in (t.name, *t.parents) if (y := spec.table(x)).segment is None for a in y.anchors for b in y.anchors):
                self.refused.add(t.name)
            for k, c in enumerate(t.columns):
                if c.index or c.pick != "first":
                    self.refused.add(t.name)
                if c.segment is not None:
                    looked.setdefault(c.segment, set()).update(p for p, _ in c.where)
                if t.segment is not None:
                    continue
                above = c.loop is not None and c.loop not in t.anchors and any(c.loop in spec.chain(a) for a in t.anchors)
                for loop in t.anchors if c.loop is None else (c.loop,):
                    self.groups.setdefault((t.name, loop, c.segment, c.where, c.occurrence, above), []).append(k)
        self.looked = {k: tuple(sorted(v)) for k, v in looked.items() if v}
        self.checker = Checker(spec)
        self.plans: dict[tuple, list] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, tuple[dict, tuple]] = {}
        self.steps: list[Step] = []
        self.arrays: dict = {}
        self.begin = self._state((None, (), frozenset()))

    def _state(self, state: tuple) -> dict:
        """The steps from a state; the state itself stands under None."""
        got = self.states.get(state)
        if got is None:
            got = self.states[state] = {None: state}
        return got

    def work_out(self, here: dict, key, pieces: list, separator: bytes) -> Step:
        loop, frames, roots = here[None]
        s = Segment(0, 0, 0, 1, 1, pieces[0], pieces, separator)
        longer = dataclasses.replace(s, pieces=pieces + [b""] * 64)  # control elements are looked for by columns
        move, check, occurrence = self.machine.move(loop, s), _Structure(self.relaxed, frames, roots), None
        for _ in move.closes:
            check.closes(longer)
        for x, implicit in move.opens:
            check.opens(x, implicit, longer, "")
        live, feeds = frozenset(o.loop for o in check.open), frozenset()
        if move.holder is not None:
            occurrence = self.machine.occurrence(move.holder, s)
            check.captured(move.holder, longer, occurrence)
            feeds = frozenset(self._feeds(move.holder, s, occurrence))
            if move.ends:
                check.closes(longer)
        clean = move.holder is not None and not check.found
        step = Step(len(self.steps), s.id, move.closes, move.opens, move.holder, occurrence, live, move.ends, clean, feeds, self._state((move.state, check.frames(), frozenset(check.roots))))
        self.steps.append(step)
        here[key] = step
        return step

    def closes_clean(self, here: dict) -> bool:
        """Whether the end of the input finds nothing missing."""
        _, frames, roots = here[None]
        check = _Structure(self.relaxed, frames, roots)
        while check.open:
            check.closes(None)
        return not check.found

    def _feeds(self, holder: int, s: Segment, occurrence: int | None):
        for g in self.groups:
            _, loop, segment, where, wanted, _ = g
            if loop == holder and segment == s.id and (wanted == occurrence if wanted is not None else all(s.simple(p) == v for p, v in where)):
                yield g
        for t in self.spec.tables:
            if t.segment == s.id and holder in t.anchors:
                yield t.name

    def array(self, key, of) -> np.ndarray:
        """A number or truth of each step, kept."""
        got = self.arrays.get(key)
        if got is None or len(got) < len(self.steps):
            got = self.arrays[key] = np.array([of(x) for x in self.steps])
        return got


@functools.lru_cache(16)
def scanner(spec: Spec) -> Scanner:
    return Scanner(spec)


def scanned(data: bytes, spec: Spec, d: Delimiters) -> "Scan | None":
    """None: a file that only Run reads."""
    if d.release is not None or data.startswith(BOM) or len(data) > LARGE:
        return None
    return Scan(data, scanner(spec), d)


class Scan:
    def __init__(self, data: bytes, of: Scanner, d: Delimiters):
        if len(of.steps) > _REMEMBERED or len(of.states) > _REMEMBERED:
            of.reset()
        self.of, self.spec, self.d = of, of.spec, d
        self.frames = data.split(d.segment)
        self.terminated = not self.frames[-1]
        if self.terminated:
            self.frames.pop()
        element = d.element
        self.pieces = [x.lstrip(TRIVIA).split(element) for x in self.frames]
        looked, here, separator, steps, at = of.looked, of.begin, d.component, [], []
        self.empty = False
        for i, p in enumerate(self.pieces):
            id = p[0]
            if not id and len(p) == 1:  # white space
                self.empty = True
                continue
            ks = looked.get(id)
            if ks is None:
                key = id
            elif len(ks) == 1:
                k = ks[0]
                key = (id, separator, p[k] if k < len(p) else None)
            else:
                key = (id, separator, *[p[k] if k < len(p) else None for k in ks])
            step = here.get(key)
            if step is None:
                step = of.work_out(here, key, p, separator)
            steps.append(step)
            at.append(i)
            here = step.then
        self.steps, self.last = steps, here
        self.at = np.array(at, np.int64) if self.empty else np.arange(len(steps))  # numbers of the segments that hold something
        if self.empty:
            self.pieces = [self.pieces[i] for i in at]
        self.ids = np.fromiter([x.id for x in steps], np.int64, len(steps))
        self._opened: dict = {}
        self._amounts: dict = {}

    # Places

    def where(self, key, of) -> np.ndarray:
        """Positions of the segments whose step has a property."""
        return np.flatnonzero(self.of.array(key, of).astype(bool)[self.ids]) if self.steps else np.zeros(0, np.int64)

    def opened(self, loops: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions that open one of the loops; for each segment the number of the last instance, and whether it is open."""
        got = self._opened.get(loops)
        if got is None:
            n = self.of.array(("opens", loops), lambda x: sum(o in loops for o, _ in x.opens))[self.ids] if self.steps else np.zeros(0, np.int64)
            live = self.of.array(("live", loops), lambda x: not x.live.isdisjoint(loops))[self.ids] if self.steps else np.zeros(0, bool)
            got = self._opened[loops] = np.flatnonzero(n), np.cumsum(n) - 1, live
        return got

    def taken(self, at: np.ndarray, c: Column, starts: list | None = None) -> list:
        """The text of a column in the segments at some places."""
        pieces, sep = self.pieces, self.d.component
        if starts is None:
            e = c.element
            texts = [p[e] if e < len(p) else None for p in map(pieces.__getitem__, at.tolist())]
        elif c.element is not None:
            e = c.element
            texts = [p[e] if e < len(p) else None for p in map(pieces.__getitem__, at.tolist())]
        else:
            o = c.offset
            texts = [p[s + o] if s + o < len(p) else None for p, s in zip(map(pieces.__getitem__, at.tolist()), starts)]
        if c.component is None:
            return texts
        k = c.component - 1
        if k == 0:
            return [t if t is None else t.split(sep, 1)[0] for t in texts]
        return [None if t is None or len(parts := t.split(sep)) <= k else parts[k] for t in texts]

    # Rows

    def table(self, name: str) -> "Rows":
        t = self.spec.table(name)
        return self._lines(t) if t.segment is not None else self._instances(t)

    def _parents(self, t: Table, at: np.ndarray) -> list[pa.Array]:
        out = []
        for p in t.parents:
            _, number, live = self.opened(self.spec.table(p).anchors)
            out.append(pa.array(number[at], pa.int64(), mask=~live[at]))
        return out

    def _instances(self, t: Table) -> "Rows":
        rows, number, live = self.opened(t.anchors)
        cells: list = [None] * len(t.columns)
        for g, columns in self.of.groups.items():
            if g[0] != t.name:
                continue
            at = self.where(("feeds", g), lambda x, g=g: g in x.feeds)
            if g[-1]:  # of a loop above: what it holds when the row begins
                begins, instance, _ = self.opened((g[1],))
                n = instance[at]
                first = np.full(len(begins) + 1, -1)
                keep = np.flatnonzero(np.diff(n, prepend=-2)) if len(n) else n
                first[n[keep]] = at[keep]
                source = first[instance[rows]]
                to = np.flatnonzero((source >= 0) & (source < rows) & (instance[rows] >= 0))
                source = source[to]
            else:
                at = at[live[at]]
                n = number[at]
                keep = np.flatnonzero(np.diff(n, prepend=-2)) if len(n) else n
                source, to = at[keep], n[keep]
            for k in columns:
                texts = self.taken(source, t.columns[k])
                if len(source) == len(rows) and cells[k] is None:
                    cells[k] = texts
                elif texts:
                    into = cells[k] = cells[k] or [None] * len(rows)
                    for i, v in zip(to.tolist(), texts):
                        into[i] = v
        return Rows(t, np.arange(len(rows)), self.at[rows], self._parents(t, rows), cells)

    def _lines(self, t: Table) -> "Rows":
        at, sep = self.where(("feeds", t.name), lambda x: t.name in x.feeds), self.d.component
        if t.repeat is None:
            starts = [0] * len(at)
        else:
            begin, step = t.repeat
            found = [[k for k in range(begin, len(p), step) if p[k] and p[k].strip(sep)] for p in map(self.pieces.__getitem__, at.tolist())]
            at, starts = np.repeat(at, [len(x) for x in found]), [k for x in found for k in x]
        return Rows(t, np.arange(len(at)), self.at[at], self._parents(t, at), [self.taken(at, c, starts) for c in t.columns])

    # Findings

    def clean(self) -> bool:
        """Whether Run would find nothing."""
        if not all(x.clean for x in set(self.steps)) or not self.of.closes_clean(self.last):
            return False
        return self._limits() and self._controls() and self._elements() and all(self._balanced(b) for b in self.spec.balances)

    def _limits(self) -> bool:
        for x in self.spec.loops:
            at, number, _ = self.opened((x.index,))
            if x.max is not None and len(at):
                above = np.zeros(len(at), np.int64) if x.parent is None else self.opened((x.parent,))[1][at]
                if np.bincount(above).max() > x.max:
                    return False
            for i, o in enumerate(x.occurrences):
                if o.max is not None:
                    at = self.where(("held", x.index, i), lambda s, x=x, i=i: s.holder == x.index and s.occurrence == i)
                    if len(at) > o.max and np.bincount(number[at]).max() > o.max:
                        return False
        return True

    def _controls(self) -> bool:
        for x in self.spec.loops:
            k = x.control
            if not k:
                continue
            begins, number, _ = self.opened((x.index,))
            text = lambda i, e: p[e] if e < len(p := self.pieces[i]) else None
            if any(text(i, k["opener_element"]) is None for i in begins.tolist()):
                return False
            children = np.cumsum(self.of.array(("children", x.index), lambda s, x=x: sum(self.spec.loops[o].parent == x.index for o, _ in s.opens))[self.ids]) if self.steps else []
            for i in self.where(("ends", x.index), lambda s, x=x: s.holder == x.index and s.segment == x.end).tolist():
                begin = begins[number[i]]
                count = i - begin + 1 if k["count"] == "segments" else int(children[i] - children[begin])
                declared = text(i, k["count_element"])
                if declared is None or parse_unsigned(declared) != count or text(i, k["closer_element"]) != text(begin, k["opener_element"]):
                    return False
        return True

    def _elements(self) -> bool:
        of, kinds = self.of, {(x.segment, x.holder, x.occurrence) for x in set(self.steps)}
        for kind in kinds:
            plan = of.plans.get((kind, self.d.component))
            if plan is None:
                plan = of.plans[kind, self.d.component] = of.checker._plan(kind)
            if not plan:
                continue
            got = [self.pieces[i] for i in self.where(("kind", kind), lambda x, kind=kind: (x.segment, x.holder, x.occurrence) == kind).tolist()]
            widest = max(map(len, got))
            for position, e, o, low, high, codes, fine in plan:
                texts = {p[position] if position < len(p) else b"" for p in got} if position < widest else {b""}
                if b"" in texts:
                    if e.required:
                        return False
                    texts.discard(b"")
                if codes and texts <= codes and all(low <= len(x) <= high for x in texts):
                    continue
                if high and not codes:
                    if texts and (len(max(texts, key=len)) > high or len(min(texts, key=len)) < low):
                        return False
                    continue
                texts -= fine
                if e.type == "R" and not e.parts and e.min <= 1 and texts and self._right(texts, e):
                    continue
                if len(fine) > _FINE:
                    fine.clear()
                for x in texts:
                    self._element(position, e, o, kind, x)
                    if of.checker.found:
                        of.checker.found.clear()
                        return False
                    if e.type != "R":  # too many to remember
                        fine.add(x)
        return True

    @staticmethod
    def _right(texts: set, e) -> bool:
        """Amounts that are plainly well formed and no longer than allowed."""
        most = 15 + e.scale
        joined = b"\n".join(texts) + b"\n"
        return joined.count(b"\n") == len(texts) and bool(_numbers(e.scale).fullmatch(joined)) and (e.max is None or most <= e.max or max(map(len, texts)) <= e.max)

    def _element(self, position: int, e, o, kind: tuple, text: bytes) -> None:
        self.of.checker._element(Segment(0, 0, 0, 1, 1, kind[0], [kind[0], *[b""] * (position - 1), text], self.d.component), position, e, o)

    def _cents(self, at: np.ndarray, key, element: int, component: int | None, scale: int):
        """Amounts in units of the last place, what has a text, and what is no amount."""
        got = self._amounts.get((key, element, component, scale))
        if got is None:
            sep = self.d.component
            texts = [p[element] if element < len(p) else b"" for p in map(self.pieces.__getitem__, at.tolist())]
            if component is not None or any(sep in t for t in texts):
                k = (component or 1) - 1
                texts = [parts[k] if k < len(parts := t.split(sep)) else b"" for t in texts]
            numbers = decimals(texts, scale)
            if len(max(texts, key=len, default=b"")) + scale > 18:
                return None  # does not fit 64 bits
            null = np.asarray(numbers.is_null())
            value = np.where(null, 0, np.frombuffer(numbers.buffers()[1], np.int64)[::2][numbers.offset : numbers.offset + len(texts)]) if len(texts) else np.zeros(0, np.int64)
            if len(value) and int(np.abs(value).max()) * len(value) >> 57:
                return None  # nor would sums
            given = np.fromiter(map(bool, texts), bool, len(texts))
            got = self._amounts[key, element, component, scale] = value, given, null
        return got

    def _balanced(self, b) -> bool:
        begins, number, live = self.opened((b.per,))
        n = len(begins)
        target, total, seen, blocked = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        for is_target, terms in ((True, b.target), (False, b.sum)):
            for t in terms:
                key = ("held", t.loop, t.occurrence)
                at = self.where(key, lambda s, t=t: s.holder == t.loop and s.occurrence == t.occurrence)
                of, on = number[at], live[at]
                widest = max((len(self.pieces[i]) for i in at.tolist()), default=0)
                for element, required in t.elements:
                    if element >= widest and not required and not is_target:
                        continue
                    got = self._cents(at, key, element, t.component, b.scale)
                    if got is None:
                        return False
                    value, given, null = got
                    bad = null & (given | required)
                    if not on.all():
                        value, bad = np.where(on, value, 0), bad & on
                    np.add.at(target if is_target else total, of, -value if t.negative else value)
                    blocked[of[bad]] = True
                if is_target:
                    seen[of[on]] = True
        return bool((blocked | ~seen | (target == total)).all())


class Rows:
    """The rows of a table: numbers, segments, parents, and the texts of each column (None: all null)."""

    def __init__(self, table: Table, number: np.ndarray, segment: np.ndarray, parents: list[pa.Array], texts: list):
        self.table, self.number, self.segment, self.parents, self.texts = table, number, segment, parents, texts

    def __len__(self) -> int:
        return len(self.number)

    def values(self, c: Column, texts: list | None, kind: pa.DataType) -> pa.Array:
        if texts is None:
            return pa.nulls(len(self), kind)
        if c.kind == "decimal":
            return decimals(texts, c.scale)
        if c.kind != "binary":
            read = {"int": parse_n, "date": parse_dt, "time": parse_tm}[c.kind]
            texts = [read(x) if x else None for x in texts]
        return pa.array(texts, kind)

    def arrays(self, kinds: list[pa.DataType]) -> list[pa.Array]:
        """Arrow columns of the given types: row, segment, parents, columns. ArrowInvalid: a text isn't UTF-8."""
        first = 2 + len(self.parents)
        return [pa.array(self.number, pa.int64()), pa.array(self.segment, pa.int64()), *self.parents, *(self.values(c, x, k) for c, x, k in zip(self.table.columns, self.texts, kinds[first:]))]
